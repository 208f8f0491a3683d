"""Sequential-greedy kernels: suppression, assignment, packing, masks and polygons, in numpy.

Each runs on one small group (an image, a batch, a stream) inside a grouped
map; nothing here needs a whole table.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the padded costs of the small assignments that are solved side by side.
CELLS = 1 << 19
CORNERS = ("x1", "y1", "x2", "y2")


def box_iou(a: np.ndarray, b: np.ndarray, eps: float = 1e-7) -> np.ndarray:
    """Overlaps of all boxes of ``a`` with all of ``b``, or of each of a stack of both."""
    side = lambda k: np.clip(np.minimum(a[..., :, None, k + 2], b[..., None, :, k + 2]) - np.maximum(a[..., :, None, k], b[..., None, :, k]), 0, None)
    inter = side(0) * side(1)
    size = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    return inter / (size(a)[..., :, None] + size(b)[..., None, :] - inter + eps)


def suppress(boxes: np.ndarray, scores: np.ndarray, limit: float) -> list[int]:
    """Greedy suppression: by falling score, ties by place, a box goes if it overlaps a kept one by more than ``limit``."""
    left = np.lexsort((np.arange(len(scores)), -scores))
    kept: list[int] = []
    while len(left):
        first, left = left[0], left[1:]
        kept.append(int(first))
        left = left[~(box_iou(boxes[first : first + 1], boxes[left], 0.0)[0] > limit)]
    return kept


def suppress_groups(boxes: np.ndarray, group: np.ndarray, limit: float) -> np.ndarray:
    """Greedy suppression in many groups at once; rows stand group by group, surest first. Says which rows are kept.

    In each round every group keeps its first living row and drops what that
    overlaps, so there are as many rounds as the fullest group keeps rows.
    """
    kept = np.zeros(len(boxes), bool)
    alive = np.arange(len(boxes))
    while len(alive):
        own = group[alive]
        first = np.ones(len(alive), bool)
        first[1:] = own[1:] != own[:-1]
        leader = alive[np.flatnonzero(first)[np.cumsum(first) - 1]]
        kept[alive[first]] = True
        a, b = boxes[leader], boxes[alive]
        inter = np.prod(np.clip(np.minimum(a[:, 2:4], b[:, 2:4]) - np.maximum(a[:, :2], b[:, :2]), 0, None), axis=1)
        size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            gone = inter / (size(a) + size(b) - inter) > limit
        alive = alive[~first & ~gone]
    return kept


def nms(dets: DataFrame, conf: float = 0.25, limit: float = 0.45, agnostic: bool = False, most: int = 300, most_in: int = 30000, classes: list[int] | None = None) -> DataFrame:
    """Suppression by class in each image; at most ``most`` boxes are kept, of the ``most_in`` surest.

    The images of a task are taken together: rows come sorted by image, and
    what a batch holds of its last image waits for the next one. There is no
    time limit, so results don't depend on the machine.
    """
    rows = dets.where(F.col("conf") > conf).select("image_id", "det_id", "x1", "y1", "x2", "y2", "conf", "cls")
    rows = rows if classes is None else rows.where(F.col("cls").isin(classes))

    def place_in(owner: np.ndarray) -> np.ndarray:
        new = np.ones(len(owner), bool)
        new[1:] = owner[1:] != owner[:-1]
        return np.arange(len(owner)) - np.flatnonzero(new)[np.cumsum(new) - 1]

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        image, cls = frame["image_id"].to_numpy(), frame["cls"].to_numpy()
        order = np.lexsort((frame["det_id"].to_numpy(), -frame["conf"].to_numpy(float), image))
        order = order[place_in(image[order]) < most_in]
        if not agnostic:
            order = order[np.lexsort((np.arange(len(order)), cls[order], image[order]))]
        key = image[order].astype(np.int64)
        group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | ((cls[order][1:] != cls[order][:-1]) & (not agnostic))]) if len(order) else key
        kept = order[suppress_groups(frame[["x1", "y1", "x2", "y2"]].to_numpy(float)[order], group, limit)]
        kept = kept[np.lexsort((frame["det_id"].to_numpy()[kept], -frame["conf"].to_numpy(float)[kept], image[kept]))]
        return frame.iloc[kept[place_in(image[kept]) < most]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            whole = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = whole["image_id"].to_numpy() == whole["image_id"].iloc[-1] if len(whole) else np.zeros(0, bool)
            rest = whole[last]
            if not last.all():
                yield work(whole[~last].reset_index(drop=True))
        if rest is not None and len(rest):
            yield work(rest.reset_index(drop=True))

    return rows.repartition("image_id").sortWithinPartitions("image_id").mapInPandas(run, rows.schema)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of least total cost, one for each row or column of the smaller side: shortest augmenting paths with potentials."""
    if not cost.size:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, done = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            done[j] = True
            r = row_of[j]
            free = ~done[1:]
            reduced = c[r - 1] - u[r] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j
            k = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            step = least[k]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            j = k
            if not row_of[j]:
                break
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    pairs = [(int(row_of[j]) - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def assign_within(cost: np.ndarray, most: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Assignment that leaves rows and columns open rather than pair them above ``most``: pairs, open rows, open columns.

    Only rows and columns with a pair within the limit are laid out, and
    each group of them that hangs together is solved on its own.
    """
    near = cost <= most
    pairs: list[tuple[int, int]] = []
    left = set(np.flatnonzero(near.any(1)).tolist()) if cost.size else set()
    while left:
        rows, cols, edge = set(), set(), {left.pop()}
        while edge:
            rows |= edge
            found = set(np.flatnonzero(near[sorted(edge)].any(0)).tolist()) - cols
            cols |= found
            edge = (set(np.flatnonzero(near[:, sorted(found)].any(1)).tolist()) if found else set()) - rows
        left -= rows
        r, c = sorted(rows), sorted(cols)
        if len(r) == len(c) == 1:
            pairs.append((r[0], c[0]))
            continue
        part = cost[np.ix_(r, c)]
        wide = np.full((len(r), len(c) + len(r)), most)
        wide[:, : len(c)] = np.where(part > most, most * 2 + 1e6, part)
        pairs += [(r[i], c[j]) for i, j in assign(wide) if j < len(c) and part[i, j] <= most]
    pairs.sort()
    used_r, used_c = {i for i, _ in pairs}, {j for _, j in pairs}
    return pairs, [i for i in range(cost.shape[0]) if i not in used_r], [j for j in range(cost.shape[1]) if j not in used_c]


def by_size(rows: np.ndarray, cols: np.ndarray) -> Iterator[np.ndarray]:
    """Places of groups of like size, so many at a time as fill CELLS when all are padded to the largest; a larger one comes alone."""
    order = np.lexsort((cols, rows))
    start = widest = 0
    for at, (n, m) in enumerate(zip(rows[order].tolist(), cols[order].tolist())):
        if at > start and (at + 1 - start) * n * max(widest, m) > CELLS:
            yield order[start:at]
            start, widest = at, 0
        widest = max(widest, m)
    if len(order):
        yield order[start:]


def padded(size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Rows of the groups ``own`` where groups of ``size`` rows stand one after the other: groups x rows, -1 where a group has no more."""
    at = np.arange(size[own].max(initial=0))
    return np.where(at < size[own][:, None], (np.cumsum(size) - size)[own][:, None] + at, -1)


def assign_many(cost: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """``assign`` for a stack of finite costs, groups x rows x columns: the row of each column of each group, or -1.

    The first ``rows`` of a group are its own, and its columns are those that
    ``cols`` marks, no fewer than its rows. Each row is placed in all groups
    side by side, by the arithmetic of ``assign``, so pairs and ties are the
    same. Groups whose path has ended stay idle until they are many, then
    the others go on without them.
    """
    u, v = np.zeros(cost.shape[:2]), np.zeros((cost.shape[0], cost.shape[2]))
    row_of, shut = np.full(v.shape, -1, np.int32), np.where(cols, 0.0, np.inf)
    for i in range(cost.shape[1]):
        own = np.flatnonzero(rows > i)
        least = cost[own, i] - v[own] + shut[own]
        g = np.arange(len(own))
        j = np.argmin(least, 1)
        step = least[g, j]
        u[own, i] += step
        taken = row_of[own, j] >= 0
        row_of[own[~taken], j[~taken]] = i
        # The rest walk on: least reduced costs, the columns they come from, columns that are done (as factors, and as costs), rows seen.
        own, j, least = own[taken], j[taken], least[taken] - step[taken, None]
        g, live = np.arange(len(own)), np.ones(len(own), bool)
        a, b, bar, done, seen = u[own], v[own], shut[own], np.zeros(least.shape), np.zeros((len(own), u.shape[1]))
        way, held = np.full(least.shape, -1, np.int32), row_of[own]
        seen[:, i] = 1
        while len(own):
            done[g, j], bar[g, j], least[g, j] = 1, np.inf, np.inf
            r = held[g, j]
            seen[g, r] = 1
            reduced = cost[own, r] - a[g, r][:, None] - b + bar
            np.copyto(way, j[:, None], where=reduced < least, casting="same_kind")
            np.minimum(least, reduced, out=least)
            j = np.argmin(least, 1)
            step = least[g, j][:, None]
            # A group that is idle may have no column left.
            step[~live] = 0
            a += seen * step
            b -= done * step
            least -= step
            ended = np.flatnonzero(live & (held[g, j] < 0))
            if not len(ended):
                continue
            live[ended] = False
            u[own[ended]], v[own[ended]] = a[ended], b[ended]
            walk, at = ended, j[ended]
            while len(walk):
                back = way[walk, at]
                row_of[own[walk], at] = np.where(back < 0, i, row_of[own[walk], back])
                walk, at = walk[back >= 0], back[back >= 0]
            if live.sum() * 3 < len(live) * 2:
                own, j, least, a, b, bar, done, seen, way, held = (x[live] for x in (own, j, least, a, b, bar, done, seen, way, held))
                g, live = np.arange(len(own)), np.ones(len(own), bool)
    return row_of


def joined(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts that hang together in each of a stack of links, groups x rows x columns: of each row and each column the first row of its part, the count of rows where it has no link."""
    none = np.int32(near.shape[1])
    rows = np.where(near.any(2), np.arange(none, dtype=np.int32), none)
    while True:
        cols = np.where(near, rows[:, :, None], none).min(1, initial=none)
        least = np.minimum(rows, np.where(near, cols[:, None], none).min(2, initial=none))
        if (least == rows).all():
            return rows, cols
        rows = least


def assign_many_within(cost: np.ndarray, rows: np.ndarray, cols: np.ndarray, most: float) -> np.ndarray:
    """``assign_within`` for a stack of costs with ``rows`` and ``cols`` of each group: group, row and column of each pair, in this order."""
    count, high, wide = cost.shape
    row_part, col_part = joined((cost <= most) & (np.arange(high) < rows[:, None])[:, :, None] & (np.arange(wide) < cols[:, None])[:, None])
    row_g, row_i = np.nonzero(row_part < high)
    col_g, col_j = np.nonzero(col_part < high)
    # A part is a problem of its own: its rows and its columns in order, then a column for each row that may stay open.
    parts, row_at = np.unique(row_g * high + row_part[row_g, row_i], return_inverse=True)
    col_at = np.searchsorted(parts, col_g * high + col_part[col_g, col_j])
    row_i, col_j = row_i[np.argsort(row_at, kind="stable")], col_j[np.argsort(col_at, kind="stable")]
    n, m, owner = np.bincount(row_at, minlength=len(parts)), np.bincount(col_at, minlength=len(parts)), parts // max(high, 1)
    found = [np.zeros((0, 3), int)]
    for own in by_size(n, n + m):
        r_at, c_at = padded(n, own), padded(m, own)
        r, c = row_i[r_at], col_j[c_at]
        part = cost[owner[own][:, None, None], r[:, :, None], c[:, None]]
        laid = np.concatenate([np.where(part <= most, part, most * 2 + 1e6), np.full((len(own), r.shape[1], r.shape[1]), most)], 2)
        row = assign_many(laid, n[own], np.concatenate([c_at >= 0, r_at >= 0], 1))[:, : c.shape[1]]
        p, j = np.nonzero(row >= 0)
        i = row[p, j]
        found.append(np.stack([owner[own][p], r[p, i], c[p, j]], 1)[part[p, i, j] <= most])
    pairs = np.concatenate(found)
    return pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]


def images_of(rows: DataFrame, is_det: Column, det: list[str], true: list[str]) -> DataFrame:
    """image_id, dets, truths: the rows of each image that has both, as lists of ``det`` and of ``true``; rows without an image meet none."""
    lists = [F.collect_list(F.when(c, F.struct(*names))).alias(n) for c, names, n in ((is_det, det, "dets"), (~is_det, true, "truths"))]
    return rows.where("image_id is not null").groupBy("image_id").agg(*lists).where("size(dets) > 0 and size(truths) > 0")


def _images(dets: DataFrame, truths: DataFrame, det: list[str], true: list[str]) -> DataFrame:
    """As ``images_of``, from two tables."""
    a, b = (x.groupBy("image_id").agg(F.collect_list(F.struct(*names)).alias(n)) for x, names, n in ((dets, det, "dets"), (truths, true, "truths")))
    return a.join(b, "image_id")


def _fields(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Lengths of lists of rows, and their fields one after the other, each list by its first field."""
    flat = lists.flatten()
    size = lists.value_lengths().to_numpy()
    names = [f.name for f in flat.type]
    order = np.lexsort((flat.field(names[0]).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)))
    out = {}
    for n in names:
        x = flat.field(n)
        out[n] = (x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if pa.types.is_list(x.type) else x.to_numpy(zero_copy_only=False))[order]
    return size, out


_PAIRS = "image_id bigint, det_id bigint, gt_id bigint, cost double"


def _pairs(image: pa.Array, own: np.ndarray, det: np.ndarray, true: np.ndarray, cost: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([image.take(pa.array(own)).cast(pa.int64()), pa.array(det, pa.int64()), pa.array(true, pa.int64()), pa.array(cost, pa.float64())], ["image_id", "det_id", "gt_id", "cost"])


DET, TRUE = ["det_id", *CORNERS], ["gt_id", *CORNERS]


def optimal_match_images(images: DataFrame, most: float = 0.8) -> DataFrame:
    """``optimal_match`` of rows of ``images_of``, with DET and TRUE as lists. Images of like size are solved side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (n, d), (m, t) = _fields(batch.column(1)), _fields(batch.column(2))
            a, b = (np.stack([x[k].astype(float) for k in CORNERS], 1) for x in (d, t))
            for own in by_size(n, m):
                r, c = padded(n, own), padded(m, own)
                cost = 1 - box_iou(a[r], b[c])
                g, i, j = assign_many_within(cost, n[own], m[own], most).T
                yield _pairs(batch.column(0), own[g], d["det_id"][r[g, i]], t["gt_id"][c[g, j]], cost[g, i, j])

    return images.select("image_id", "dets", "truths").mapInArrow(run, _PAIRS)


def optimal_match(dets: DataFrame, truths: DataFrame, most: float = 0.8) -> DataFrame:
    """Pairs of least total 1 - IoU in each image, none above ``most``."""
    return optimal_match_images(_images(dets, truths, DET, TRUE), most)


def set_match_cost(boxes: np.ndarray, scores: np.ndarray, truths: np.ndarray, classes: np.ndarray, alpha: float = 0.25, gamma: float = 2.0, weights: tuple[float, float, float] = (1.0, 5.0, 2.0)) -> np.ndarray:
    """Costs of set prediction: focal class cost, L1 distance of centre boxes and 1 - GIoU, weighted; of one group or of each of a stack."""
    focal = alpha * (1 - scores) ** gamma * -np.log(scores + 1e-8) - (1 - alpha) * scores**gamma * -np.log(1 - scores + 1e-8)
    focal = np.take_along_axis(focal, np.broadcast_to(classes[..., None, :], (*scores.shape[:-1], classes.shape[-1])), -1)
    far = [np.abs(boxes[..., :, None, k] - truths[..., None, :, k]) for k in range(4)]
    l1 = far[0] + far[1] + far[2] + far[3]
    corners = lambda b: np.concatenate([b[..., :2] - b[..., 2:] / 2, b[..., :2] + b[..., 2:] / 2], -1)
    a, b = corners(boxes), corners(truths)
    side = lambda k: np.maximum(a[..., :, None, k + 2], b[..., None, :, k + 2]) - np.minimum(a[..., :, None, k], b[..., None, :, k])
    hull = side(0) * side(1) + 1e-7
    overlap = box_iou(a, b)
    size = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    total = size(a)[..., :, None] + size(b)[..., None, :]
    union = total / (1 + overlap)
    return weights[0] * focal + weights[1] * l1 + weights[2] * (1 - (overlap - (hull - union) / hull))


CENTRES = ("cx", "cy", "w", "h")
PREDICTION, CENTRED = ["det_id", *CENTRES, "scores"], ["gt_id", *CENTRES, "cls"]


def set_match_images(images: DataFrame) -> DataFrame:
    """``set_match`` of rows of ``images_of``, with PREDICTION and CENTRED as lists. Images of like size are solved side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (n, p), (m, t) = _fields(batch.column(1)), _fields(batch.column(2))
            a, b = (np.stack([x[k].astype(float) for k in CENTRES], 1) for x in (p, t))
            scores, known = p["scores"].astype(float), ~np.isnan(t["cls"].astype(float))
            cls = np.where(known, t["cls"], 0).astype(int)
            for turned in (False, True):
                part = np.flatnonzero((n > m) == turned)
                for own in (part[at] for at in by_size(n[part], m[part])):
                    r, c = padded(n, own), padded(m, own)
                    cost = set_match_cost(a[r], scores[r], b[c], cls[c])
                    # What is unknown has no cost; it is paired after all that has one.
                    laid = np.where(np.isfinite(cost) & known[c][:, None], cost, 1e6)
                    if turned:
                        row = assign_many(laid.transpose(0, 2, 1), m[own], r >= 0)
                        g, i = np.nonzero(row >= 0)
                        j = row[g, i]
                    else:
                        row = assign_many(laid, n[own], c >= 0)
                        g, j = np.nonzero(row >= 0)
                        i = row[g, j]
                    yield _pairs(batch.column(0), own[g], p["det_id"][r[g, i]], t["gt_id"][c[g, j]], laid[g, i, j])

    return images.select("image_id", "dets", "truths").mapInArrow(run, _PAIRS)


def set_match(preds: DataFrame, truths: DataFrame) -> DataFrame:
    """Predictions and truths of each image paired at least cost of set prediction: image_id, det_id, gt_id, cost.

    ``preds`` has normalised centre boxes (cx, cy, w, h) and scores by
    class, ``truths`` centre boxes and cls; the smaller side is matched whole.
    Pairs of unknown cost, such as those of a null, count 1e6.
    """
    return set_match_images(_images(preds, truths, PREDICTION, CENTRED))


def knapsacks(lengths: list[int], capacity: int) -> list[list[int]]:
    """Places of ``lengths`` in packs: each time the largest length that fits, of equal lengths the last place first."""
    places: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        places.setdefault(n, []).append(i)
    left = sorted(n for n in lengths if n <= capacity)
    packs = []
    while left:
        pack, room = [], capacity
        while True:
            at = bisect.bisect_right(left, room) - 1
            if at < 0:
                break
            n = left.pop(at)
            room -= n
            pack.append(places[n].pop())
        packs.append(pack)
    return packs


def components(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a mask, numbered from 1 in the order of their first pixel.

    Runs of a row are joined with those of the row above that they touch;
    only runs are walked, never pixels.
    """
    h, w = mask.shape
    out = np.zeros((h, w), int)
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, starts = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    up = list(range(len(ys)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(ys, np.arange(h + 1))
    for y in range(1, h):
        i, j, end_i, end_j = first[y - 1], first[y], first[y], first[y + 1]
        while i < end_i and j < end_j:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    number: dict[int, int] = {}
    for k in range(len(ys)):
        out[ys[k], starts[k] : ends[k]] = number.setdefault(root(k), len(number) + 1)
    return out


def without_small(mask: np.ndarray, least: int, mode: str) -> tuple[np.ndarray, bool]:
    """Removes islands, or fills holes, of fewer than ``least`` pixels; if all islands are small the largest stays. Says if anything changed."""
    work = mask if mode == "islands" else ~mask
    labels = components(work)
    sizes = np.bincount(labels.ravel())[1:]
    small = [i + 1 for i, s in enumerate(sizes) if s < least]
    if not small:
        return mask, False
    if mode == "holes":
        return mask | np.isin(labels, small), True
    keep = [i + 1 for i in range(len(sizes)) if i + 1 not in small] or [int(np.argmax(sizes)) + 1]
    return np.isin(labels, keep), True


def polygon_mask(points: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pixels whose centre lies inside a polygon, by the even-odd rule along scan lines."""
    mask = np.zeros((h, w), bool)
    xs, ys = points[:, 0], points[:, 1]
    nx, ny = np.roll(xs, -1), np.roll(ys, -1)
    for y in range(h):
        cy = y + 0.5
        hit = (ys <= cy) != (ny <= cy)
        cross = np.sort(xs[hit] + (cy - ys[hit]) * (nx[hit] - xs[hit]) / (ny[hit] - ys[hit]))
        for a, b in zip(cross[::2], cross[1::2]):
            mask[y, max(0, int(np.ceil(a - 0.5))) : max(0, min(w, int(np.floor(b - 0.5)) + 1))] = True
    return mask


def outline(mask: np.ndarray) -> np.ndarray:
    """Corner points of the outer border of a mask's largest component, clockwise, by following pixel edges."""
    labels = components(mask)
    if not labels.any():
        return np.zeros((0, 2))
    part = labels == int(np.argmax(np.bincount(labels.ravel())[1:])) + 1
    inside = lambda y, x: 0 <= y < part.shape[0] and 0 <= x < part.shape[1] and part[y, x]
    y, x = next(zip(*np.nonzero(part)))
    start, at, step = (x, y), (x, y), (1, 0)
    points = [at]
    while True:
        at = (at[0] + step[0], at[1] + step[1])
        dx, dy = step
        # Pixels ahead on the left and on the right of the edge just walked.
        ahead_left = {(1, 0): (at[1] - 1, at[0]), (0, 1): (at[1], at[0]), (-1, 0): (at[1], at[0] - 1), (0, -1): (at[1] - 1, at[0] - 1)}[step]
        ahead_right = {(1, 0): (at[1], at[0]), (0, 1): (at[1], at[0] - 1), (-1, 0): (at[1] - 1, at[0] - 1), (0, -1): (at[1] - 1, at[0])}[step]
        turn = (dy, -dx) if inside(*ahead_left) else (dx, dy) if inside(*ahead_right) else (-dy, dx)
        if at == start:
            break
        if turn != step:
            points.append(at)
        step = turn
    return np.array(points, float)


def resample(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` points evenly along a closed polygon's point numbers."""
    closed = np.concatenate([points, points[:1]])
    x = np.linspace(0, len(closed) - 1, n)
    at = np.arange(len(closed))
    return np.stack([np.interp(x, at, closed[:, 0]), np.interp(x, at, closed[:, 1])], 1)


def joined_segments(segments: list[np.ndarray]) -> np.ndarray:
    """Polygons connected at their nearest points into one, each walked out and back."""
    out = segments[0]
    for s in segments[1:]:
        d = ((out[:, None] - s[None]) ** 2).sum(2)
        i, j = np.unravel_index(np.argmin(d), d.shape)
        turned = np.roll(s, -j, 0)
        out = np.concatenate([out[: i + 1], turned, turned[:1], out[i:]])
    return out


def run_lengths(mask: np.ndarray) -> list[int]:
    """Column-wise run lengths of a mask, beginning with the zeros."""
    flat = mask.T.ravel().astype(bool)
    change = np.flatnonzero(np.diff(flat)) + 1
    edges = np.concatenate([[0], change, [flat.size]])
    runs = np.diff(edges).tolist()
    return ([0] if flat.size and flat[0] else []) + runs


def from_runs(runs: list[int], h: int, w: int) -> np.ndarray:
    flat = np.zeros(h * w, bool)
    at = 0
    for i, n in enumerate(runs):
        flat[at : at + n] = i % 2 == 1
        at += n
    return flat.reshape(w, h).T


def assemble_masks(protos: np.ndarray, coefficients: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Masks from prototypes (c, h, w) and coefficients (n, c): above one half after a sigmoid, inside their boxes."""
    c, h, w = protos.shape
    logits = (coefficients @ protos.reshape(c, -1)).reshape(-1, h, w)
    ys, xs = np.arange(h)[None, :, None], np.arange(w)[None, None, :]
    x1, y1, x2, y2 = (boxes[:, i][:, None, None] for i in range(4))
    return (logits > 0) & (xs >= x1) & (xs < x2) & (ys >= y1) & (ys < y2)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def kmeans(points: np.ndarray, k: int, seed: int = 42, rounds: int = 50, starts: int = 5) -> np.ndarray:
    """Cluster numbers of points: the best of a few seeded starts."""
    best, found = np.inf, np.zeros(len(points), int)
    for s in range(starts):
        rng = np.random.default_rng(seed + s)
        centres = points[rng.choice(len(points), k, replace=False)].astype(float)
        for _ in range(rounds):
            d = ((points[:, None] - centres[None]) ** 2).sum(2)
            near = d.argmin(1)
            moved = np.array([points[near == i].mean(0) if (near == i).any() else centres[i] for i in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        total = d.min(1).sum()
        if total < best:
            best, found = total, near
    return found
