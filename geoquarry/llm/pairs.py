"""Problem 7: broken prompt and response pairs, by parsing, string tiling, script checks and refusal grammars."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.functions.text import normal_form
from geoquarry.storage import materialize

TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
HAN = re.compile(r"[一-鿿]")
#: Scripts told apart besides Latin; a text is in the script of most of its letters.
SCRIPTS = {"han": re.compile(r"[㐀-鿿]"), "kana": re.compile(r"[぀-ヿ]"), "hangul": re.compile(r"[가-힯]"), "cyrillic": re.compile(r"[Ѐ-ӿ]"), "arabic": re.compile(r"[؀-ۿ]"), "greek": re.compile(r"[Ͱ-Ͽ]"), "latin": re.compile(r"[A-Za-zÀ-ɏ]")}

# Closed-class words by language (articles, prepositions, particles, quantifiers, forms of to be, question
# words), then the basic words of any word list: colours, numbers, sizes and directions. They label texts from which the
# profiles of a language are learned, and count a little in the profiles themselves.
FUNCTION_WORDS = {
    "en": "the of and is are was were be on at to from with what which where how many does there any this that by it for not can yes none several "
    "white black red green blue yellow grey brown one two three four five large small left right top bottom north south east west",
    "de": "der die das den dem ein eine und ist sind auf bei mit von zu wie viele welche wo nicht kein keine neben liegt es gibt hier dort sich auch nur noch ja nein kaum etwa für vom zum als mehrere "
    "weiß schwarz rot grün blau gelb grau braun hell dunkel eins zwei drei vier fünf groß klein links rechts oben unten nord süd ost norden süden osten westen",
    "fr": "le la les du de un une et est sont dans sur au aux en combien quelle où il près pas à avec d l qu on des ne ce cette très que oui non aucun aucune dont plusieurs "
    "blanc noir rouge vert bleu jaune gris brun clair foncé deux trois quatre cinq grand petit gauche droite haut bas nord sud est ouest",
    "es": "el la los las de del un una y es son en hay qué cuántos dónde se al con por junto cerca lo muy más sin sobre que sí pocos pocas muchos varios "
    "blanco negro rojo verde azul amarillo gris marrón claro oscuro dos tres cuatro cinco grande pequeño izquierda derecha arriba abajo norte sur este oeste",
    "pt": "os de da dos das um uma é são em na há que não com por quantos onde ao perto sim vários "
    "branco preto vermelho verde azul amarelo cinza castanho claro escuro dois três quatro cinco grande pequeno esquerda direita cima baixo norte sul leste oeste",
    "it": "il gli di del della una è sono nel che non con per quanti dove al "
    "bianco nero rosso verde blu giallo grigio marrone chiaro scuro due tre quattro cinque grande piccolo sinistra destra alto basso nord sud est ovest",
}
LABELS: dict[str, tuple[str, ...]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        LABELS[_w] = (*LABELS.get(_w, ()), _language)
LANGUAGES = tuple(FUNCTION_WORDS)
WORD = re.compile(r"[^\W\d_]+")
#: Rows from which profiles are learned, at most; a seeded sample by hash where there are more.
PROFILE_ROWS = 100_000
PROFILE_BITS = 16
#: Share of a language's words below which a count says nothing, and how much likelier (natural log) another language must be.
FLOOR, MARGIN = 2e-5, 3.0
#: Weight of the trigrams of a word that no profile holds.
TRIGRAMS = 0.5

#: Words that no finished sentence ends with.
DANGLING = frozenset(
    "a an the of and or with to at by as is are was were be because which that than from into for but several if when while whose its their der das dem den ein eine einen einem einer und oder mit von zu bei neben im am sind ist weil le la les un une des du de et ou avec est sont à au aux dans sur parce que qui el los las una unos del y o con es son en al porque".split()
)
DANGLING_HAN = ("位于", "以及", "靠近", "因为", "并且", "和", "与", "的", "在", "是因", "而且", "或者", "及")

EMPTY = re.compile(
    r"\s*(?:n\s*/\s*a|n\.a\.|null|nan|nil|undefined|tbd|todo|<[^<>]{0,40}>|\[(?:answer|response|blank|empty|placeholder|no answer|none|null)\]|\{[^{}]{0,40}\}|(?:the\s+)?(?:final\s+)?(?:answer|response|reply|output|assistant|model|a|antwort|réponse|reponse|respuesta|resposta|答案|回答|答)\s*(?:is)?\s*[:：]\s*(?:n\s*/\s*a|null|none|nan)?)\s*[.。]*\s*$"
    r"|\s*\[?\s*(?:error|exception|traceback|timeout|fatal)\b\s*[\]:].*$|\s*\[(?:error|exception|timeout)[^\]]*\].*$|\s*(?:runtimeerror|valueerror|keyerror|timeouterror|filenotfounderror|cuda error|out of memory|http error|connection (?:error|refused|reset))\b.*$",
    re.I | re.S,
)

# The grammar of a refusal. <x> is a nonterminal, " .. " is anything inside one sentence, | parts alternatives.
GRAMMAR = {
    "refusal": "<no-reply>|<excused>|<impossible>|<rule>|<machine>|<unwilling>|<unanswered>|<german>|<french>|<spanish>|<portuguese>|<chinese>|<russian>",
    # English: someone who is asked cannot do what a reply takes.
    "self": r"\b(?:i|we|assistant|model)\b",
    "cannot": r"\b(?:cannot|can not|can't|unable|won't|will not|(?:'m|am|are|is) not able|could not|couldn't|not permitted|not allowed)\b",
    "reply": r"\b(?:answer|help|assist|process|view|determine|provide|respond|describe|analy[sz]e|inspect|discuss|guess|identify|identifying|locate|tell|comply|open|access|look at|reply|fulfil\w*|<see>)",
    "see": r"see (?:the|this|that|any|your) (?:image|picture|photo|tile|file)|(?:see|view) (?:images|pictures|photos)",
    "no-reply": r"<self> .. <cannot> .. <reply>|\bcan(?:'t|not) (?:help|assist|answer|comply)\b",
    "sorry": r"\b(?:sorry|apolog\w+|unfortunately|regret\w*)\b",
    "beyond": r"\b(?:cannot|can't|unable|won't|not able|outside|beyond|not allowed|don't have)\b",
    "task": r"\b(?:answer|help|assist|process|view|determine|provide|respond|describe|analy[sz]\w+|identify\w*|locat\w+|discuss|access|request|information|comply)",
    "excused": "<sorry> .. <beyond> .. <task>",
    "impossible": r"\b(?:not|im)possible for me\b|\bno way for me\b|\bi have no (?:means|way|access|ability|permission)\b|\boutside what i\b|\bbeyond (?:my|what i)\b|\bagainst my\b|\bnot within my\b",
    "rule": r"\bmy (?:\w+ )?(?:guidelines|rules|polic\w+|instructions|training|settings) (?:do|does|don't|doesn't|prevent|forbid|prohibit)",
    "machine": r"\b(?:as|being) an? (?:\w+[ -]){0,3}(?:ai|language model|assistant|text model|llm)\b",
    "unwilling": r"\bi (?:do not|don't) know\b|\b(?:rather|prefer) not\b .. \b(?:guess|say|answer|speculate|comment)|\bprefer not to\b|\b(?:do not|don't) feel comfortable\b|\bnot comfortable\b|\bi (?:must |have to |will )?(?:decline|refuse)\b|\bplease ask something else\b",
    "unanswered": r"\bi (?:do not|don't) have (?:\w+ ){0,2}(?:access|permission|ability|information|means)\b|\bquestions? (?:could|can) ?not be (?:answered|processed)\b|\bcould not be answered\b|\bno (?:answer|reply|response) (?:is|can be|will be) (?:given|provided)\b",
    # German
    "german": r"\bich (?:kann|darf|möchte|werde)\b .. \b(?:nicht|keine?n?)\b .. \b<antworten>|\bsprachmodell\b|\bkeine?n? (?:zugriff|berechtigung)\b|\bnicht möglich, (?:diese|die) |\bmir (?:ist es )?(?:leider )?nicht möglich\b|\btut mir leid\b",
    "antworten": "(?:beantworten|helfen|ansehen|sehen|analysieren|verarbeiten|beurteilen|sagen|äußern|antworten|bearbeiten|beschreiben)",
    # French
    "french": r"\bje ne (?:peux|puis|suis|saurais|veux)\b .. \b(?:pas|répondre|analyser|voir|aider|en mesure)\b|\bdésolée?\b|\bnavrée?\b|\bimpossible (?:pour moi|de répondre|d'aider|d'analyser)|\bmodèle de langage\b|\bpas en mesure\b|\bje n'ai pas (?:accès|le droit)",
    # Spanish, Portuguese
    "spanish": r"\bno (?:puedo|podré|podría|me es posible|soy capaz|estoy autorizad[oa]|tengo (?:acceso|permiso))\b|\blo siento\b|\bmodelo de lenguaje\b|\bme resulta imposible\b",
    "portuguese": r"\bnão (?:posso|consigo|tenho (?:acesso|permissão))\b|\bmodelo de linguagem\b|\bdesculpe\b",
    # Chinese, Russian
    "chinese": r"(?:我|请求|问题)[^。！？]{0,12}(?:无法|不能|没有权限|不便|没办法)|抱歉|对不起|语言模型|无法<回答>|不能<回答>",
    "回答": "(?:回答|分析|查看|处理|判断|提供)",
    "russian": r"\bне могу\b|\bк сожалению\b|\bязыковая модель\b",
}


def production(symbol: str) -> str:
    """The pattern of a symbol of the grammar: its productions with every nonterminal in place."""
    body = GRAMMAR[symbol].replace(" .. ", r"[^.!?]*")
    return "(?:" + re.sub(r"(?<!\?)<([\w-]+)>", lambda m: production(m.group(1)), body) + ")"


REFUSAL = re.compile(production("refusal"), re.I)

ASKING = frozenset("what which where how many who when why is are does do was were can wie viele wo welche welcher was sind ist gibt liegen combien où quel quelle y-a-t-il cuántos cuántas dónde qué cuál hay quantos onde 多 少 什 么 吗 哪 几".split())
CLOSERS = {")": "(", "]": "[", "}": "{", "」": "「", "）": "（", "】": "【", "》": "《", "”": "“", "»": "«"}
OPENERS = frozenset(CLOSERS.values())
END = re.compile(r"[.!?。！？…][\"'”’»)\]）】」\s]*$")
CUT = re.compile(r"(?:\.\.\.|…|[,，、:：;；(（\[{\-–—/&+=])\s*$")


#: Tags that hold nothing.
VOID = frozenset("br image video audio hr p li img".split())
_SYMBOL = re.compile(r"```|</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>|^[ \t]*(?:[-*•]|\d{1,3}[.)])(?=\s|$)|[()\[\]{}「」（）【】《》“”«»\"\n]", re.M)
_OPEN_TAG = re.compile(r"</?[A-Za-z][^<>]*$")


def unclosed(text: str) -> bool:
    """Whether a pushdown parse of fences, tags, brackets, quotations and list items ends with something open.

    A closer takes everything above its opener off the stack; one without an
    opener is plain text. Inside a fence only the fence counts. A straight
    quotation mark opens at the beginning of a word and closes the one that
    is open. A list item is open until it has any text. A tag that the text
    breaks off in is open.
    """
    stack: list[str] = []
    item = -1
    for m in _SYMBOL.finditer(text):
        sign = m.group()
        if stack and stack[-1] == "```":
            if sign == "```":
                stack.pop()
            continue
        if sign == "```":
            stack.append(sign)
        elif sign in OPENERS:
            stack.append(sign)
        elif sign in CLOSERS:
            if CLOSERS[sign] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(CLOSERS[sign]) :]
        elif sign == '"':
            if '"' in stack:
                del stack[stack.index('"') :]
            elif (m.start() == 0 or not text[m.start() - 1].isalnum()) and text[m.end() : m.end() + 1].strip():
                stack.append(sign)
        elif sign[0] == "<":
            name = sign.strip("</>").split()[0].lower()
            if sign[1] == "/":
                if f"<{name}" in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(f"<{name}") :]
            elif name not in VOID and not sign.endswith("/>"):
                stack.append(f"<{name}")
        elif sign != "\n":
            item = m.end()
    if item >= 0 and not text[item:].strip() and item > 4:
        stack.append("item")
    return bool(stack) or bool(_OPEN_TAG.search(text))


def tiles(a: list[str], b: list[str], least: int) -> tuple[list[bool], list[bool]]:
    """Greedy string tiling: longest common runs first, none overlapping; what they cover of ``a`` and ``b``."""
    in_a, in_b = [False] * len(a), [False] * len(b)
    at: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    while True:
        best, found = least - 1, None
        for i, w in enumerate(a):
            if in_a[i]:
                continue
            for j in at.get(w, ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and not in_a[i + k] and not in_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, (i, j)
        if found is None:
            return in_a, in_b
        for k in range(best):
            in_a[found[0] + k] = in_b[found[1] + k] = True


def long_tiles(a: list[str], b: list[str], least: int) -> tuple[list[bool], list[bool]]:
    """What ``tiles`` gives, for long texts: the longest common run left is found by halving over hashes of word runs.

    All runs of one length are laid in one pass; no longer one can come up
    after it, so each length is visited once.
    """
    number: dict[str, int] = {}
    sides = [[number.setdefault(w, len(number) + 1) for w in x] for x in (a, b)]
    base, prime, power = 1_000_003, (1 << 61) - 1, [1]
    for _ in range(max(len(a), len(b))):
        power.append(power[-1] * base % prime)
    sums = []
    for x in sides:
        h = [0]
        for w in x:
            h.append((h[-1] * base + w) % prime)
        sums.append(h)
    marked = ([False] * len(a), [False] * len(b))

    def runs(side: int, free: list[int], k: int) -> Iterator[tuple[int, int]]:
        h, p = sums[side], power[k]
        return ((i, (h[i + k] - h[i] * p) % prime) for i in range(len(h) - k) if free[i] >= k)

    top = min(len(a), len(b))
    while top >= least:
        free = []
        for m in marked:
            left = [0] * (len(m) + 1)
            for i in range(len(m) - 1, -1, -1):
                left[i] = 0 if m[i] else left[i + 1] + 1
            free.append(left)
        low, high = least - 1, top
        while low < high:
            k = (low + high + 1) // 2
            have = {h for _, h in runs(1, free[1], k)}
            low, high = (k, high) if any(h in have for _, h in runs(0, free[0], k)) else (low, k - 1)
        if low < least:
            break
        at: dict[int, deque[int]] = {}
        for j, h in runs(1, free[1], low):
            at.setdefault(h, deque()).append(j)
        for i, h in runs(0, free[0], low):
            places = at.get(h)
            # What is laid at this length has its length, so a run overlaps it at one of its ends.
            while places and (marked[1][places[0]] or marked[1][places[0] + low - 1]):
                places.popleft()
            if places and not (marked[0][i] or marked[0][i + low - 1]) and a[i : i + low] == b[places[0] : places[0] + low]:
                marked[0][i : i + low] = marked[1][places[0] : places[0] + low] = [True] * low
        top = low - 1
    return marked


def copies_question(question: list[str], answer: list[str], truth: list[str]) -> bool:
    """Whether the answer is the question again: its words laid out in tiles, a lead-in before them, and nothing that replies."""
    if len(question) < 2 or len(answer) < 0.7 * len(question):
        return False
    have = set(answer)
    if sum(w in have for w in question) < 0.8 * len(question) or len(answer) > len(question) + 12:
        return False
    if not all(w in have for w in question if w in ASKING):
        return False
    lay = long_tiles if len(question) * len(answer) > 10_000 else tiles
    in_q, in_a = lay(question, answer, 1 if len(question) < 4 else 2)
    if sum(in_q) < 0.8 * len(question) or True not in in_a:
        return False
    first = in_a.index(True)
    over = [w for w, covered in zip(answer[first:], in_a[first:]) if not covered]
    known = set(question)
    said = [w for w in over if w not in known]
    if any(w.isdigit() or w in truth for w in said):
        return False
    lead = set(answer[:first])
    return len(said) <= max(2, len(question) // 6) and first <= 10 and not lead & {"yes", "no", "ja", "nein", "oui", "non", "sí", "是", "否"}


def script(text: str) -> str | None:
    counts = {name: len(p.findall(text)) for name, p in SCRIPTS.items()}
    # A Han character says as much as a Latin word, and names stay Latin in any text.
    if counts["han"] or counts["kana"] or counts["hangul"]:
        return max(("han", "kana", "hangul"), key=counts.get)
    best = max(counts, key=counts.get)
    return best if counts[best] else None


def labelled(words: list[str]) -> str | None:
    """The language that a text's function words tell beyond doubt: at least one and a half votes, and twice any other's."""
    got: dict[str, float] = {}
    for w in words:
        own = LABELS.get(w, ())
        for language in own:
            got[language] = got.get(language, 0.0) + 1 / len(own)
    if not got:
        return None
    first, *rest = sorted(got, key=lambda k: -got[k])
    return first if got[first] >= 1.5 and (not rest or got[first] >= 2 * got[rest[0]]) else None


def features(word: str) -> list[str]:
    """A word and its trigrams of characters, with its borders."""
    x = f"^{word}$"
    return [x, *(x[i : i + 3] for i in range(len(x) - 2))]


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << PROFILE_BITS) - 1)


class Profiles:
    """Counts of words and trigrams by language, in hash buckets.

    A word says how much more frequent it is in one language than in
    another. One that no profile holds is judged by its trigrams, which say
    less. Basic words count as one in two thousand of their languages.
    """

    def __init__(self, counts: np.ndarray) -> None:
        # The last column holds the number of words.
        part = counts[:, :-1] / np.maximum(counts[:, -1:], 1)
        for w, names in LABELS.items():
            for name in names:
                part[LANGUAGES.index(name), _bucket(f"^{w}$")] += 0.0005
        self.seen = part.sum(axis=0) > 0
        self.log = np.log(part + FLOOR)
        self.words: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        got = self.words.get(w)
        if got is None:
            if len(self.words) > 100_000:
                self.words.clear()
            first, *rest = map(_bucket, features(w))
            got = self.words[w] = self.log[:, first] if self.seen[first] else TRIGRAMS * sum(self.log[:, k] for k in rest) / len(rest)
        return got

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log of the likelihood of some words in each language."""
        total = np.zeros(len(LANGUAGES))
        for w in words:
            total = total + self.word(w)
        return total


def basic_profiles() -> Profiles:
    """Profiles of the basic words alone."""
    return Profiles(np.zeros((len(LANGUAGES), (1 << PROFILE_BITS) + 1), np.int64))


def fit_profiles(rows: DataFrame, most: int = PROFILE_ROWS) -> np.ndarray:
    """Profiles learned from the questions and answers of ``rows``: of all, or of a sample by hash of about ``most`` rows.

    Texts that their function words label are counted under their language;
    what comes to the driver is a table of fixed size.
    """
    count = rows.count()
    part = rows if count <= most else rows.where(F.pmod(F.xxhash64("rec_id"), F.lit(1_000_000)) < int(1_000_000 * most / count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[str, int]] = {name: {} for name in LANGUAGES}
        for batch in batches:
            for column in batch.columns:
                for text in column.to_pylist():
                    words = WORD.findall(text.lower()) if text else []
                    name = labelled(words)
                    if name is not None:
                        own = seen[name]
                        for w in set(words):
                            own[w] = own.get(w, 0) + 1
        out: dict[tuple[int, int], int] = {}
        for i, name in enumerate(LANGUAGES):
            for w, n in seen[name].items():
                for k in (*map(_bucket, features(w)), 1 << PROFILE_BITS):
                    out[(i, k)] = out.get((i, k), 0) + n
        keys = list(out)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([out[k] for k in keys], pa.int64())], ["l", "k", "n"])

    sums = part.select("question", "answer").mapInArrow(run, "l int, k int, n bigint").groupBy("l", "k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(LANGUAGES), (1 << PROFILE_BITS) + 1), np.int64)
    counts[sums["l"].to_numpy(), sums["k"].to_numpy()] = sums["n"].to_numpy()
    return counts


def other_language(question: str, q: list[str], answer: str, a: list[str], profiles: Profiles) -> bool:
    """Whether the answer is in another script or, by the words it adds, in another language than the question."""
    said, asked = script(answer), script(question)
    if said is None or asked is None:
        return False
    known = set(q)
    if said != asked:
        return any(w not in known and not w.isdigit() for w in a)
    if said != "latin":
        return False
    known |= set(WORD.findall(question.lower()))
    said_words = WORD.findall(answer)
    if len(said_words) > 2 and not END.search(answer):
        # The last word may be broken off.
        said_words = said_words[:-1]
    new = [w for w in said_words if w not in known]
    if not new:
        return False
    own = int(profiles.score(WORD.findall(question.lower())).argmax())
    scores = profiles.score(new)
    best = int(scores.argmax())
    return bool(best != own and scores[best] - scores[own] > MARGIN)


def common_endings(text: list[str], end: list[str]) -> list[int]:
    """For each place of ``text``, how many words up to there are also the last words of ``end``; linear, by Z values."""
    x = [*reversed(end), None, *reversed(text)]
    z = [0] * len(x)
    left = right = 0
    for i in range(1, len(x)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(x) and x[k] is not None and x[i + k] is not None and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z[:len(end):-1]


def skeleton(question: list[str], answer: list[str], truth: list[str], values: dict[str, set[tuple[str, ...]]]) -> str | None:
    """The answer's form: question words, numbers and values abstracted, the rest kept; null for a label.

    A value is the true answer or one of ``values``, by first word. A run of question words becomes Q; the last run also names
    the question's word that would come next, so that an echo broken off
    inside a phrase has another form than a whole one. A few words that
    neither echo the question nor follow a value are a label.
    """
    known, true = set(question), set(truth)
    out: list[str] = []
    i = 0
    while i < len(answer):
        w, step = answer[i], 1
        if w in true and (w not in known or len(truth) == 1) or w.isdigit():
            kind = "V"
        elif w in known:
            kind = "Q"
        else:
            fits = [v for v in values.get(w, ()) if tuple(answer[i : i + len(v)]) == v]
            kind, step = ("V", max(map(len, fits))) if fits else (w, 1)
        if not (out and out[-1] == kind and kind in "QV"):
            out.append(kind)
        i += step
    if len(answer) <= 4 and (out == ["V"] or "Q" not in out and "V" not in out):
        return None
    if out[-1] == "Q":
        # The question's word after the longest stretch that the answer's end repeats.
        lengths = common_endings(question, answer)
        j = max(range(len(question)), key=lambda j: (lengths[j], j))
        out[-1] = "Q>" + ((question[j + 1] if j + 1 < len(question) else "$") if lengths[j] else "")
    return " ".join(out)


def judge(question: str | None, answer: str | None, truth: str | None, profiles: Profiles) -> tuple[str | None, str | None, bool]:
    """Defect known from the row alone, else the form of an answer that may be truncated and whether it has a full stop."""
    text = (answer or "").replace("’", "'").replace("\u200b", "").strip()
    low = text.lower()
    a = TOKEN.findall(low)
    if not a or EMPTY.match(text):
        return "empty", None, False
    asked = question or ""
    q = TOKEN.findall(asked.replace("’", "'").lower())
    t = TOKEN.findall((truth or "").lower())
    if copies_question(q, a, t):
        return "copies_question", None, False
    if REFUSAL.search(text):
        return "refusal", None, False
    if a == t:
        return None, None, False
    if q and other_language(asked, q, low, a, profiles):
        return "other_language", None, False
    if len(a) == 1 and not HAN.match(a[0]):
        return ("truncated", None, False) if CUT.search(text) and not re.search(r"^\W*[-–—]", text) else (None, None, False)
    ended = bool(END.search(text)) and not CUT.search(text)
    if ended:
        return None, skeleton(q, a, t, {}), True
    if unclosed(text) or CUT.search(text) or a[-1] in DANGLING or text.endswith(DANGLING_HAN):
        return "truncated", None, False
    return None, skeleton(q, a, t, {}), False


def _judge(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(counts.value)
        for batch in batches:
            ids, *texts = (c.to_pylist() for c in batch.columns)
            out = [judge(q, a, t, profiles) for q, a, t in zip(*texts)]
            keep = [i for i, x in enumerate(out) if x[0] is not None or x[1] is not None]
            columns = [[ids[i] for i in keep], *([out[i][k] for i in keep] for k in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.bool_()))], ["rec_id", "defect", "form", "ended"])

    return run


def _tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").replace("’", "'").lower())


def values_said(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """rec_id and values: which ground truths of any of ``rows`` stand in the ``answers`` (rec_id, answer), word by word.

    Every run of an answer's words that is as long as some ground truth is
    joined with all distinct ground truths.
    """

    def truths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {tuple(_tokens(t)) for t in batch.column(0).to_pylist()} - {()}
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(t) for t in found], pa.string()), pa.array([len(t) for t in found], pa.int32())], ["value", "n"])

    known = materialize(rows.select("ground_truth").distinct().mapInArrow(truths, "value string, n int").distinct(), "values")
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, said = [], []
            for i, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _tokens(a)
                for x in {" ".join(words[k : k + n]) for n in lengths if n <= len(words) for k in range(len(words) - n + 1)}:
                    ids.append(i), said.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, pa.string())], ["rec_id", "value"])

    return answers.select("rec_id", "answer").mapInArrow(runs, "rec_id bigint, value string").join(known.select("value"), "value").groupBy("rec_id").agg(F.collect_set("value").alias("values"))


def _reform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rec_id and the form of an answer with all values in it abstracted."""
    for batch in batches:
        ids, forms = [], []
        for i, q, a, t, said in zip(*(c.to_pylist() for c in batch.columns)):
            values: dict[str, set[tuple[str, ...]]] = {}
            for v in said or ():
                words = tuple(v.split(" "))
                values.setdefault(words[0], set()).add(words)
            ids.append(i), forms.append(skeleton(_tokens(q), _tokens(a), _tokens(t), values))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.string())], ["rec_id", "form"])


def defects(rows: DataFrame) -> DataFrame:
    """rec_id and defect of each broken row of ``rows`` (rec_id, question, answer, ground_truth), at most one a row.

    In this order: ``empty``, ``copies_question``, ``refusal``,
    ``other_language``, ``truncated``. An answer that has the words of the
    ground truth passes at once. A null or wordless question leaves the
    checks that need it aside; a null ground truth equals nothing. A sentence
    without its full stop is truncated if it ends in something open, in a
    word that cannot end a sentence, or if its form (question words, numbers
    and the true value abstracted) hardly ever ends in a full stop anywhere
    else: forms are counted over all rows, with partial aggregation, and
    joined back. Before that verdict, values of other rows are abstracted
    too, by a join with all ground truths (``values_said``), and the form is
    looked up again.
    """
    words = normal_form(F.col("answer"))
    same = (words == normal_form(F.col("ground_truth"))) & (words != "") & (words != normal_form(F.col("question")))
    checked = rows.where(~F.coalesce(same, F.lit(False))).select("rec_id", "question", "answer", "ground_truth")
    counts = rows.sparkSession.sparkContext.broadcast(fit_profiles(rows))
    judged = materialize(checked.mapInArrow(_judge(counts), "rec_id bigint, defect string, form string, ended boolean"), "judged")
    known = judged.where("defect is not null").select("rec_id", "defect")
    forms = judged.where("form is not null").groupBy("form").agg(F.count_if("ended").alias("whole"), F.count_if(~F.col("ended")).alias("open"))
    counted = materialize(forms, "forms")
    broken = counted.where("open > 0 and whole * 4 < open").select("form")
    doubtful = materialize(judged.where("defect is null and not ended").join(broken, "form", "left_semi").select("rec_id"), "doubtful")
    texts = rows.select("rec_id", "question", "answer", "ground_truth").join(doubtful, "rec_id", "left_semi")
    again = texts.join(values_said(texts, rows), "rec_id", "left").select("rec_id", "question", "answer", "ground_truth", "values").mapInArrow(_reform, "rec_id bigint, form string")
    sound = counted.where("whole * 4 >= open and whole > 0").select("form")
    # A form that is null is a label.
    cut = again.where("form is not null").join(sound, "form", "left_anti").select("rec_id", F.lit("truncated").alias("defect"))
    return known.unionByName(cut)
