"""Problem 10: text read in a wrong character encoding, by noisy-channel decoding under corpus word frequencies."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.storage import materialize

LOST = "�"
BITS = 19
#: Log10 of the odds that a piece of text was damaged at all.
PRIOR = -2.0

_UNIT = re.compile(r"[^\W\d_]+|[^\x00-\x7f]")
_WIDE = re.compile(r"[　-ヿ㄀-㆏㐀-鿿가-힯-豈-﫿＀-￯]")
_RUSSIAN = re.compile(r"[А-яЁё]+")
_HIGH = re.compile(r"[^\x00-\x7f]+")
_MIXED = re.compile(r"[A-ZÀ-ÖØ-Þ]{2}[a-zß-öø-ÿ]|[A-Za-zÀ-ÿ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ÿ]")
_TOKEN = re.compile(r"[^\x00-\x20\x7f]*[^\x00-\x7f][^\x00-\x20\x7f]*")


def _sloppy(name: str) -> tuple[dict[str, int], list[str]]:
    """A single-byte encoding both ways; bytes it leaves undefined stand for the control character of their number."""
    chars = [bytes([b]).decode(name, "replace") for b in range(256)]
    chars = [chr(b) if c == LOST else c for b, c in enumerate(chars)]
    return {c: b for b, c in reversed(list(enumerate(chars)))}, chars


SINGLE = {n: _sloppy(n) for n in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "cp1250", "iso8859-2", "iso8859-15", "cp1253", "cp1254")}
DOUBLE = ("gb18030", "big5", "cp932", "euc-kr")
WRONG = (*SINGLE, *DOUBLE)


def to_bytes(text: str, codec: str) -> bytes | None:
    """The bytes that ``codec`` would read as ``text``, or null if there are none. ASCII stays as it is."""
    if codec in SINGLE:
        table = SINGLE[codec][0]
        out = bytearray()
        for c in text:
            b = table.get(c)
            if b is None:
                # A character of latin-1 that the encoding lacks may have been passed through.
                b = ord(c) if codec == "cp1252" and 0x80 <= ord(c) < 0xA0 else None
                if b is None:
                    return None
            out.append(b)
        return bytes(out)
    try:
        return text.encode(codec)
    except UnicodeError:
        return None


def from_bytes(data: bytes, codec: str) -> str | None:
    if codec in SINGLE:
        table = SINGLE[codec][1]
        return "".join(table[b] for b in data)
    try:
        return data.decode(codec)
    except UnicodeError:
        return None


def units(text: str) -> list[str]:
    """What is counted: words that are not all ASCII, single characters of wide scripts, and symbols but no blanks."""
    out: list[str] = []
    for w in _UNIT.findall(text):
        if w.isascii() or w == "\xa0":
            continue
        if len(w) == 1 or not _WIDE.search(w):
            out.append(w)
            continue
        at = 0
        for m in _WIDE.finditer(w):
            if m.start() > at and not (part := w[at : m.start()]).isascii():
                out.append(part)
            out.append(m.group())
            at = m.end()
        if at < len(w) and not (part := w[at:]).isascii():
            out.append(part)
    return out


def _kind(c: str) -> str:
    return " " if not c else "a" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else c


def context(text: str, i: int, c: str) -> str:
    """A character between the kinds of its neighbours."""
    return "\x00" + _kind(text[i - 1 : i]) + c + _kind(text[i + 1 : i + 2])


def utf8_readings(run: str) -> list[tuple[str, str]]:
    """(codec, text) for each encoding in which a run of high characters may be UTF-8 that was misread."""
    found = []
    for codec in WRONG:
        data = to_bytes(run, codec)
        if data is None or data.isascii():
            continue
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(text) < len(run) or codec in DOUBLE:
            if not any(0x7F < ord(c) < 0xA0 and codec not in ("cp1252", "latin-1") for c in text):
                found.append((codec, text))
    return found


def suspicious(token: str) -> bool:
    """Whether a token may be damaged by its bytes alone; such tokens are not counted as clean text."""
    if LOST in token:
        return True
    for m in _HIGH.finditer(token):
        run = m.group()
        if _RUSSIAN.fullmatch(run):
            if _turned(run):
                return True
            continue
        # Some part of the run reads as UTF-8, or it is a word of high Latin letters only.
        if len(run) > 1 and (_partial(run) or all("À" <= c <= "ÿ" for c in run)):
            return True
        if len(run) == 1 and _WIDE.match(run) and utf8_readings(run):
            return True
    return False


#: Natural logs of the share of each letter in Russian text.
_SHARE = {c: math.log(n / 1e4) for c, n in zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (1097, 845, 801, 735, 670, 626, 547, 473, 454, 440, 349, 321, 298, 281, 262, 201, 190, 174, 170, 165, 159, 144, 121, 97, 94, 73, 64, 48, 36, 32, 26, 4, 4))}
_CYRILLIC = ("cp1251", "koi8-r", "cp866")


def _russian(word: str) -> float:
    """How well a word's letters and their case fit Russian."""
    odd = sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))
    return sum(_SHARE.get(c, -9.0) for c in word.lower()) - 5 * odd - 3 * (len(word) > 1 and word.isupper())


def _turned(run: str) -> bool:
    """Whether a run of Russian letters reads better as another Cyrillic encoding."""
    own = _russian(run)
    for wrong in _CYRILLIC:
        data = to_bytes(run, wrong)
        if data is not None and any(_russian(from_bytes(data, true)) > own + 1 for true in _CYRILLIC if true != wrong):
            return True
    return False


_LEAD = {}
for _codec, (_table, _chars) in SINGLE.items():
    for _b in range(0xC2, 0xF5):
        _LEAD.setdefault(_chars[_b], []).append((_codec, 2 if _b < 0xE0 else 3 if _b < 0xF0 else 4))


def _partial(run: str) -> bool:
    """Whether a stretch inside the run is a whole UTF-8 sequence under some single-byte encoding, or the run under a wider one."""
    for i, c in enumerate(run):
        for codec, n in _LEAD.get(c, ()):
            part = run[i : i + n]
            if len(part) == n and (data := to_bytes(part, codec)) is not None:
                try:
                    text = data.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if not 0x7F < ord(text) < 0xA0:
                    return True
    return bool(_WIDE.search(run)) and any(codec in DOUBLE for codec, _ in utf8_readings(run))


class Counts:
    """Counts of units in two rows of hash buckets, of one size for any corpus; never too low, rarely too high.

    Two more rows count copies of a text too. Likelihoods of pairs of
    encodings rest on distinct texts, so that copies of a damaged text do not
    vouch for it. All else rests on every copy: what may be misread UTF-8 is
    never counted, so its copies cannot vouch for it. Beginnings of words
    are counted as well, so that a search can tell what no word begins with.
    ``alphabet`` holds the clean characters beyond ASCII.
    """

    def __init__(self, rows: np.ndarray, alphabet: str = "") -> None:
        self.rows = rows
        self.alphabet = alphabet
        #: Counts looked up already, in distinct texts and in all; a bounded number of them.
        self.known: dict[str, tuple[int, int]] = {}
        self.total = max(1.0, float(rows[4, 0]))
        self.all = max(1.0, float(rows[4, 1]))

    def both(self, unit: str) -> tuple[int, int]:
        got = self.known.get(unit)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            a, b = places(unit)
            r = self.rows
            got = self.known[unit] = int(min(r[0, a], r[1, b])), int(min(r[2, a], r[3, b]))
        return got

    def __getitem__(self, unit: str) -> int:
        return self.both(unit)[0]

    def copies(self, unit: str) -> int:
        return self.both(unit)[1]

    def log(self, text: str, copies: bool = False) -> float:
        """Log10 of a text's likelihood, by distinct texts or by all copies.

        An unseen word is spelled letter by letter; one that turns from
        capitals to small letters or mixes scripts is a thousand times less
        likely.
        """
        return self.log_of(units(text), copies)

    def log_of(self, parts: list[str], copies: bool = False) -> float:
        """``log`` of a text from its units."""
        total, whole, k = 0.0, self.all if copies else self.total, 1 if copies else 0
        for u in parts:
            n = self.both(u)[k]
            total += math.log10((n + 0.3) / whole) - (0 if n else 0.7 * (len(u) - 1)) - 3 * bool(len(u) > 1 and _MIXED.search(u))
        return total


def places(unit: str) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(unit)
    return h & ((1 << BITS) - 1), h >> (64 - BITS)


def beginnings(word: str) -> list[str]:
    """The beginnings of a word that reach beyond ASCII, marked."""
    first = next(i for i, c in enumerate(word) if c > "\x7f")
    return ["\x01" + word[:k] for k in range(first + 1, len(word) + 1)]


def distinct_texts(texts: DataFrame, column: str) -> DataFrame:
    """x, text and n: every distinct text with characters beyond ASCII, two hashes of it, and its copies."""
    high = texts.where(F.col(column).rlike(r"[^\x00-\x7f]")).groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return high.select(text_hash("text").alias("x"), "text", "n")


def text_hash(column: str):
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(1), column).alias("b"))


def token_table(distinct: DataFrame) -> DataFrame:
    """token, texts and copies: every distinct token beyond ASCII, how often it occurs in distinct texts and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, copies = Counter(), Counter()
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t, k in Counter(_TOKEN.findall(text)).items():
                    texts[t] += k
                    copies[t] += k * n
            yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.string()), pa.array(list(texts.values()), pa.int64()), pa.array([copies[t] for t in texts], pa.int64())], ["token", "texts", "copies"])

    found = distinct.select("text", "n").mapInArrow(run, "token string, texts bigint, copies bigint")
    return found.groupBy("token").agg(F.sum("texts").alias("texts"), F.sum("copies").alias("copies"))


def corpus_counts(tokens: DataFrame) -> tuple[np.ndarray, str]:
    """Counts and alphabet of the clean tokens among ``tokens``.

    At most 4 * 2^19 sums and the characters of Unicode come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((5, 1 << BITS), np.int64)
        letters: Counter = Counter()
        for batch in batches:
            for t, texts, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if suspicious(t):
                    continue
                counted = units(t)
                rows[4, 0] += texts * len(counted)
                rows[4, 1] += copies * len(counted)
                found = [*counted, *(context(t, i, c) for i, c in enumerate(t) if c > "\x7f" and not c.isalpha())]
                for w in counted:
                    if len(w) > 1:
                        found += beginnings(w)
                for u in found:
                    a, b = places(u)
                    rows[0, a] += texts
                    rows[1, b] += texts
                    rows[2, a] += copies
                    rows[3, b] += copies
                for c in set(t):
                    if c > "\x7f" and c.isprintable() and not c.isspace():
                        letters[c] += copies
        r, k = np.nonzero(rows)
        extra = np.array([ord(c) for c in letters], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r, np.full(len(extra), 9)]).astype(np.int32)), pa.array(np.concatenate([k, extra]).astype(np.int32)), pa.array(np.concatenate([rows[r, k], [letters[chr(c)] for c in extra]]).astype(np.int64))], ["r", "k", "n"])

    sums = tokens.mapInArrow(run, "r int, k int, n bigint").groupBy("r", "k").agg(F.sum("n").alias("n")).toArrow()
    rows = np.zeros((5, 1 << BITS), np.int64)
    r, k, n = (sums[c].to_numpy() for c in "rkn")
    own = r < 5
    rows[r[own], k[own]] = n[own]
    # A character of a single text may be damage that no test saw.
    return rows, "".join(chr(c) for c, m in sorted(zip(k[~own], n[~own])) if m > 1)


#: (as what it was read, what it was) for encodings of one byte, and of two bytes read as one.
_PAIRS = [(w, t) for w in ("cp1252", "latin-1") for t in ("cp1251", "koi8-r", "cp866", "gb18030", "big5", "cp932", "euc-kr", "mac_roman", "cp437", "cp850")]
_PAIRS += [(w, t) for w in ("cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp866", "cp1250") for t in ("cp1252", "cp1251", "koi8-r", "cp866") if w != t]


#: Channels for lost characters of a text in UTF-8 that was not: what the bytes were.
_UNKNOWN = ("cp1252", "cp1251", "cp1250", "mac_roman", "koi8-r", "cp437", "gb18030")
_RUNS = re.compile(r"([^\x00-\x7f]+)")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: Costs, as logs of 10: a lost character that stays lost, a lost character beside a letter that was none.
STAYS_LOST, NO_LETTER = -12.0, -4.0


class Lattice:
    """The bytes of a token as one encoding wrote them, and the ways to read them in another.

    A known character gives its bytes, a lost one (U+FFFD) a wildcard for one
    byte, a character that the encoding lacks stands for itself. An edge
    leads over the bytes of one character of the true encoding; a wildcard
    inside it stands for every character of the corpus whose bytes fit.
    """

    def __init__(self, counts: Counts) -> None:
        self.counts = counts
        self.fits: dict[str, dict[tuple, list[str]]] = {}

    def _index(self, true: str) -> dict[tuple, list[str]]:
        """Characters of the corpus by their bytes in an encoding, with every choice of bytes left open."""
        got = self.fits.get(true)
        if got is None:
            got = self.fits[true] = {}
            for c in self.counts.alphabet:
                data = to_bytes(c, true)
                if data is None or len(data) > 4 or data[0] < 0x80:
                    continue
                for mask in product((True, False), repeat=len(data)):
                    # Of a character of several bytes one must be known.
                    if not all(mask) and (any(mask) or len(data) == 1):
                        got.setdefault(tuple(b if keep else None for b, keep in zip(data, mask)), []).append(c)
        return got

    def cells(self, token: str, wrong: str) -> tuple[list, dict[int, tuple[str, int]]]:
        """Bytes of a token (None for a lost one, a text for what stands for itself) and the characters as read, by place."""
        data: list = []
        at: dict[int, tuple[str, int]] = {}
        for c in token:
            part: list = [None] if c == LOST else [ord(c)] if c < "\x80" else list(to_bytes(c, wrong) or [c]) if wrong != "utf-8" else [c]
            at[len(data)] = (c, len(part))
            data += part
        return data, at

    def edges(self, data: list, at: dict[int, tuple[str, int]], i: int, true: str) -> list[tuple[int, list[str], bool]]:
        """(bytes, characters, guessed) of every step from place ``i``."""
        v = data[i]
        if isinstance(v, str):
            return [(1, [v], False)]
        if v is not None and v < 0x80:
            return [(1, [chr(v)], False)]
        out: list[tuple[int, list[str], bool]] = []
        for n in (2, 3, 4) if true == "utf-8" else (1,) if true in SINGLE else (2,):
            part = data[i : i + n]
            if len(part) < n or any(isinstance(b, str) for b in part):
                break
            if None in part:
                fits = self._index(true).get(tuple(part))
                if fits:
                    out.append((n, fits, True))
            else:
                text = from_bytes(bytes(part), true) if true != "utf-8" else _utf8(bytes(part))
                if text is not None and len(text) == 1:
                    out.append((n, [text], False))
        if v is None:
            out.append((1, [LOST], False))
        elif i in at and not any(not guessed for _, _, guessed in out):
            c, n = at[i]
            out.append((n, [c], False))
        return out

    def best(self, token: str, wrong: str, true: str) -> tuple[float, str] | None:
        """Score and text of the likeliest reading of a token along the lattice, or null if none reaches the end.

        Without wildcards there is one way. With them, a Viterbi search goes
        over places and the word begun there: a word closes with its count
        in the corpus, a guess is followed only as far as a known word
        begins like it, wide characters count each on its own, symbols by
        the kinds of their neighbours. No state that may win is dropped.
        """
        data, at = self.cells(token, wrong)
        if None not in data:
            text = only_way(token, wrong, true)
            return None if text is None else (self.counts.log(text, True), text)
        log, count, total = math.log10, self.counts.copies, self.counts.all
        # place -> (word begun, guessed) -> (score, characters so far as a linked list)
        ways: list[dict[tuple[str, bool], tuple[float, tuple | None]]] = [{} for _ in range(len(data) + 1)]
        ways[0][("", False)] = (0.0, None)

        def close(word: str, guessed: bool) -> float | None:
            if not word or word.isascii():
                return 0.0
            if LOST in word:
                return None if guessed else 0.0
            n = count(word)
            if guessed and n < 2:
                return None
            return log((n + 0.3) / total) - (0 if n else 0.7 * (len(word) - 1)) - 3 * bool(_MIXED.search(word))

        for i in range(len(data)):
            if not ways[i]:
                continue
            steps = self.edges(data, at, i, true)
            for (word, guessed), (score, path) in ways[i].items():
                for n, chars, guess in steps:
                    follows = token_char(at, i + n)
                    for c in chars:
                        wide = bool(_WIDE.match(c))
                        cost = STAYS_LOST if c == LOST else 0.0
                        if (c.isalpha() or c == LOST) and not wide:
                            grown, open_ = word + c, guessed or guess
                            if open_ and LOST not in grown and not grown.isascii() and not count("\x01" + grown):
                                continue
                            state = (grown, open_)
                        else:
                            closed = close(word, guessed)
                            if closed is None:
                                continue
                            cost += closed
                            if wide:
                                cost += log((count(c) + 0.3) / total)
                            elif c > "\x7f":
                                before = path[0] if path else ""
                                known = count("\x00" + _kind(before) + c + _kind(follows))
                                if guess and known < 2:
                                    continue
                                cost += log((known + 0.3) / total) + (NO_LETTER if guess and (before.isalpha() or follows.isalpha()) else 0.0)
                            state = ("", False)
                        had = ways[i + n].get(state)
                        if had is None or score + cost > had[0]:
                            ways[i + n][state] = (score + cost, (c, path))
            ways[i] = {}
        ends = [(score + closed, path) for (word, guessed), (score, path) in ways[-1].items() if (closed := close(word, guessed)) is not None]
        if not ends:
            return None
        score, path = max(ends, key=lambda e: e[0])
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return score, "".join(reversed(out))


def only_way(token: str, wrong: str, true: str) -> str | None:
    """The one way through the lattice of a token that has lost nothing, null if there is none or it changes nothing.

    In a single-byte encoding every sequence of UTF-8 is read as its
    character and all else stays; in wider ones a run is UTF-8 throughout.
    Other pairs of encodings turn every run of high characters.
    """
    if true != "utf-8":
        out = []
        for part in _RUNS.split(token):
            if part.isascii():
                out.append(part)
                continue
            data = to_bytes(part, wrong)
            text = None if data is None or data.isascii() else from_bytes(data, true)
            if text is None:
                return None
            out.append(text)
    elif wrong in SINGLE:
        out = []
        for part in _RUNS.split(token):
            data = None if part.isascii() else to_bytes(part, wrong)
            if data is None and not part.isascii():
                # Some character is not of the encoding: the stretches between such characters are read on their own.
                table = SINGLE[wrong][0]
                pieces, run = [], ""
                for c in part:
                    if c in table or wrong == "cp1252" and "\x80" <= c < "\xa0":
                        run += c
                    else:
                        pieces += [run, c]
                        run = ""
                out += [_sequences(x, to_bytes(x, wrong)) if i % 2 == 0 and x else x for i, x in enumerate([*pieces, run])]
            else:
                out.append(part if data is None else _sequences(part, data))
    else:
        out = []
        for part in _RUNS.split(token):
            data = None if part.isascii() else to_bytes(part, wrong)
            text = None if data is None else _utf8(data)
            out.append(part if text is None else text)
    text = "".join(out)
    return None if text == token else text


def _sequences(part: str, data: bytes) -> str:
    """A run of a single-byte encoding, its sequences of UTF-8 read as characters."""
    out, at = [], 0
    for m in _SEQUENCE.finditer(data):
        text = _utf8(m.group())
        if text is not None:
            out += [part[at : m.start()], text]
            at = m.end()
    return "".join(out) + part[at:]


def token_char(at: dict[int, tuple[str, int]], i: int) -> str:
    """The character as read that begins at a place, or nothing."""
    return at[i][0] if i in at else ""


def _utf8(data: bytes) -> str | None:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


class Decoder:
    """Finds and restores damaged tokens under the corpus counts."""

    def __init__(self, counts: Counts) -> None:
        self.counts = counts
        self.lattice = Lattice(counts)

    def read(self, token: str, wrong: str, true: str) -> str | None:
        """The token along its byte lattice, null where that gives nothing or changes nothing."""
        if LOST not in token:
            return only_way(token, wrong, true)
        way = self.lattice.best(token, wrong, true)
        return None if way is None or way[1] == token else way[1]

    def decode(self, token: str) -> tuple[str, tuple[str, str] | None, tuple[np.ndarray, np.ndarray] | None]:
        """The likeliest original of a token and its channel, null if the token is likelier as it stands; then its ``gains``.

        Channels are UTF-8 misread up to three times over, other pairs of
        encodings, and, where characters are lost, UTF-8 as which the bytes
        of another encoding were read. A lost character has no likelihood as
        it stands, so some channel always wins there.
        """
        if LOST in token:
            return (*self._lost(token), None)
        log = self.counts.log
        base = log(token, True)
        best, found, how = -PRIOR, token, None
        runs = _HIGH.findall(token)
        if any(len(r) > 1 or _WIDE.match(r) for r in runs):
            for codec in WRONG:
                text, own = token, (0.0 if codec in ("cp1252", "latin-1") else 0.2)
                for _ in range(3):
                    text = self.read(text, codec, "utf-8") or (self.read(text, "latin-1", "utf-8") if codec == "cp1252" else None)
                    if text is None:
                        break
                    if text != token and (gain := log(text, True) - base) > best + own:
                        best, found, how = gain, text, (codec, "utf-8")
        # How much likelier the token is when read through each pair of encodings, and whether that reading is known.
        base = log(token)
        gains, good = np.full(len(_PAIRS), -1.0), np.zeros(len(_PAIRS), np.int64)
        for k, pair in enumerate(_PAIRS):
            text = self.read(token, *pair)
            if text is None:
                continue
            parts = units(text)
            low = min((self.counts.copies(u) for u in parts), default=0)
            gain = gains[k] = self.counts.log_of(parts) - base
            good[k] = low >= 3 and len(runs[0]) > 1
            if low >= 3 and gain > best + 0.5 and sum(len(u) for u in parts) >= (2 if pair[1] in DOUBLE or len(runs[0]) > 2 else 3):
                best, found, how = gain, text, pair
        return found, how, None if how is not None else (gains, good)

    def _lost(self, token: str) -> tuple[str, tuple[str, str]]:
        channels = [(w, "utf-8") for w in WRONG if len(token) > 1] + [("utf-8", t) for t in _UNKNOWN]
        best, found, how = -math.inf, token, ("utf-8", _UNKNOWN[0])
        for wrong, true in channels:
            way = self.lattice.best(token, wrong, true)
            if way is not None and way[0] > best:
                (best, found), how = way, (wrong, true)
        return found, how


def together(gains: list[tuple[np.ndarray, np.ndarray]]) -> tuple[str, str] | None:
    """The pair of encodings in which the tokens of one text that may be damaged, taken together, are far likelier than as they stand.

    Left out are tokens that every pair makes ten times less likely, such as the
    clean part of a text; how frequent a token is does not matter.
    """
    gain, good = np.zeros(len(_PAIRS)), np.zeros(len(_PAIRS), np.int64)
    for own, known in gains:
        if own.max() > -1.0:
            gain += own
            good += known
    gain[good < 2] = -np.inf
    best = int(gain.argmax())
    return _PAIRS[best] if gain[best] > 1.0 - PRIOR else None


def readings(tokens: DataFrame, counts) -> DataFrame:
    """th, better, wrong, true, gain and good of every token with evidence of damage: what it says decoded once, whatever texts it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Counts(*counts.value))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.int64()))
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for t in batch.column(0).to_pylist():
                better, how, gains = decoder.decode(t)
                if how is None and gains[0].max() <= -1.0:
                    continue
                gain, good = gains if how is None else (None, None)
                for column, x in zip(out, (token_hash(t), better, how[0] if how else None, how[1] if how else None, None if gain is None else gain.tolist(), None if good is None else good.tolist())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["th", "better", "wrong", "true", "gain", "good"])

    # Tokens are few but dear: dealt anew over all tasks.
    return tokens.select("token").repartition(max(1, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, "th bigint, better string, wrong string, true string, gain array<double>, good array<bigint>")


def token_hash(token: str) -> int:
    h = xxhash.xxh64_intdigest(token)
    return h - (1 << 64) if h >> 63 else h


def text_tokens(distinct: DataFrame) -> DataFrame:
    """x and th: the distinct tokens beyond ASCII of every distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, th = [], []
            known: dict[str, int] = {}
            for i, text in enumerate(batch.column(1).to_pylist()):
                for t in set(_TOKEN.findall(text)):
                    h = known.get(t)
                    if h is None:
                        h = known[t] = token_hash(t)
                    at.append(i), th.append(h)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(th, pa.int64())], ["x", "th"])

    return distinct.select("x", "text").mapInArrow(run, "x struct<a:bigint,b:bigint>, th bigint")


def restore(text: str, evidence: dict[int, tuple], counts: Counts, decoder: Decoder) -> tuple[bool, str]:
    """Whether a text is damaged anywhere, and the text with what could be restored, from the readings of its tokens by hash."""
    how: Counter = Counter()
    damaged = False
    pieces: list[tuple[int, int, str, str]] = []
    gains: dict[str, tuple] = {}
    for m in _TOKEN.finditer(text):
        token = better = m.group()
        got = evidence.get(token_hash(token))
        if got is not None:
            better, wrong, true, gain, good = got
            if wrong is not None:
                damaged = True
                how[(wrong, true)] += LOST not in token
            else:
                gains[token] = np.array(gain), np.array(good)
        pieces.append((m.start(), m.end(), token, better))
    # Words of one text that are odd each on its own may agree on an encoding.
    how = +how
    main = max(how, key=how.get) if how else None
    if len(gains) > 1 and (main is None or main[1] == "utf-8") and (pair := together(list(gains.values()))) is not None:
        damaged, main = True, pair
        how[pair] = len({t for _, _, t, b in pieces if t == b and LOST not in t})
    if not damaged:
        return False, text
    # Short words say little alone: they follow the encoding of the rest, where they are no rarer in it.
    out, at = [], 0
    for start, end, token, better in pieces:
        if better == token and main is not None and main[1] != "utf-8" and how[main] > 1 and LOST not in token:
            other = decoder.read(token, *main)
            if other is not None and counts.log(other) >= counts.log(token) - 1:
                better = other
        out += [text[at:start], better]
        at = end
    return True, "".join(out) + text[at:]


def garbled(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``restored`` and ``complete`` of each document with garbled characters in it.

    Counts of clean words, wide characters and symbols over all documents
    are the language model, in a sketch of fixed size. Every distinct token
    beyond ASCII is decoded once: for each channel, a wrong and a true
    encoding, its bytes form a lattice with wildcards for lost bytes, and
    the likeliest way through it wins if it beats the token as it stands by
    the odds of damage; a lost character has no likelihood as it stands. The
    readings are joined to the distinct texts that hold the token, and the
    texts to their documents. ``complete`` says that nothing lost remains.
    Null, empty and ASCII texts are never garbled.
    """
    spark = documents.sparkSession
    distinct = materialize(distinct_texts(documents.select(text), text), "distinct")
    tokens = materialize(token_table(distinct), "tokens")
    counts = spark.sparkContext.broadcast(corpus_counts(tokens))
    found = materialize(readings(tokens, counts), "readings")
    pairs = text_tokens(distinct).join(found, "th").groupBy("x").agg(F.collect_list(F.struct("th", "better", "wrong", "true", "gain", "good")).alias("e"))
    damaged = pairs.join(distinct.select("x", "text").hint("merge"), "x").select("x", "text", "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counts(*counts.value)
        decoder = Decoder(own)
        for batch in batches:
            at, good = [], []
            for i, (t, e) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                bad, text_ = restore(t, {r["th"]: (r["better"], r["wrong"], r["true"], r["gain"], r["good"]) for r in e}, own, decoder)
                if bad:
                    at.append(i), good.append(text_)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(good, pa.string()), pa.array([LOST not in g for g in good], pa.bool_())], ["x", "restored", "complete"])

    texts = damaged.mapInArrow(run, "x struct<a:bigint,b:bigint>, restored string, complete boolean")
    own = documents.select(F.col(key).alias("_key"), text_hash(text).alias("x")).where(F.col(text).rlike(r"[^\x00-\x7f]"))
    return own.join(materialize(texts, "restored"), "x").select(F.col("_key").alias(key), "restored", "complete")
