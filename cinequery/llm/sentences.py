"""Sentences of texts in any language (problem 8).

A linear-chain model tags each character as inside or as the last of a sentence, and Viterbi decoding
picks the best tagging of a paragraph. All characters that cannot end a sentence are inside, so they need no
decision and no step of the chain; those that can are the end marks of all scripts (Unicode's
Sentence_Terminal) with what closes after them, but for the point within a number, and a space in scripts
that set no end marks. Blank lines always end a sentence, so paragraphs are independent chains.

The model is trained here, by the averaged perceptron, on at most ``TRAINING_DOCUMENTS`` documents of
the corpus itself and on the few sentences of ``WRITTEN``. Their labels come from rules that are sure where case, quotation marks and known
abbreviations show the structure. The model is also trained on copies without capitals, where these
signs are gone, and, for scripts without end marks, on paragraphs joined by spaces with all
punctuation stripped; so it learns from the words around a mark. Every document is then cut by it.

Offsets count code points of the text as it is. Characters that are not drawn are passed over in the
decision and stay with the text before them.

Defined results: null texts and texts of white space or undrawn characters only have no sentence;
a text without any mark is one sentence a paragraph; quotation marks that are never closed count as
plain characters; copies of a document give copies of its rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.functions.characters import MARKS, UNDRAWN, ranges

#: Documents, at most, on which the model is trained, and the largest share of a text used there.
TRAINING_DOCUMENTS = 2_500
TRAINING_CHARACTERS = 20_000
EPOCHS = 5
#: Scores that a task remembers.
REMEMBERED = 200_000

_CAPITAL = re.compile(f"[{ranges(str.isupper)}]")
_UNDRAWN, _MN = re.compile(f"[{UNDRAWN}]"), re.compile(f"[{MARKS}]+")
#: Scripts that separate sentences by a space and set no end marks: Thai, Lao.
_SPACED = "฀-໿"
_CLOSERS = "\"'”“»’)\\]}」』）】〉》"
_WIDE = "。！？｡！？︒"
# The other marks of Unicode's Sentence_Terminal property in the first plane, without the Myanmar little section
# and the presentation forms, which separate parts of sentences or are rare; and the Tibetan shads.
_OWN = "։؝؞܀܁܂߹࠷࠹࠽࠾༎།။።፧፨᙮᜵᜶។៕᠃᠉᥄᥅᪨᪩᪪᪫᭚᭛᭞᭟᰻᰼᱾᱿‼‽⁇⁈⁉⳹⳺⳻⸮⸼꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫"
_ENDS = f".!?…؟۔।॥{_WIDE}{_OWN}"
_MARKED = rf"[{_ENDS}]+(?:(?<=[^.])|(?!\d)|(?<=[^\d.]\.))(?:[   ]?[{_CLOSERS}](?![^\W_]))*"
_SPACE = rf"(?<=[{_SPACED}\d])[^\S\n]*\n?[^\S\n]*(?<=\s)(?=\S)"
_CANDIDATE, _CANDIDATE_SPACED = re.compile(_MARKED), re.compile(f"{_MARKED}|{_SPACE}")
_HAS_SPACED = re.compile(f"[{_SPACED}]")
_WORDS, _FIRST = re.compile(r"\w+"), re.compile(r"\W*(\w*)")
_BREAK = re.compile(r"[\s“”„«»\"'()\[\]「」『』,;:!?…。！？]")
_MARKS = frozenset(_ENDS)
#: Marks that are set at ends only; what is learned of one holds for all.
_PLAIN = frozenset(_WIDE + _OWN)
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_OPEN, _CLOSE = "“„«「『‘‚‹《〈", "”“»」』’›》〉"
_QUOTE = re.compile("[\"“”„«»「」『』《》]")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "《": "》", "»": "«"}

# Abbreviations, folded, that do not end a sentence by themselves, and those that may.
ABBREVIATIONS = frozenset(
    """
    tp q p h tr th ts ths gs pgs bs ks kts ls tx tt nxb vd
    dr mr mrs ms prof st sgt lt capt col gen rev no nos fig figs vs cf approx min max vol ch sec pp eg ie viz esp incl
    jan feb mar apr jun jul aug sep sept oct nov dec
    m mm mme mlle pr me ex env av bd ste
    z u i s d b ca bzw evtl abb hrn hr fr dipl ing nr str bspw ggf vgl
    т е г ул стр рис руб им проф акад гл см напр тыс млн
    д डॉ श्री प्रो د أ
    """.split()
)
MAY_END = frozenset("etc inc ltd co corp pcs jr sr a.m p.m v.v usw т.д т.п и.д и.п д".split())
GOES_ON = frozenset("and or but va und et ou и y".split())
MONTHS = frozenset("januar februar marz april mai juni juli august september oktober november dezember".split())


@lru_cache(maxsize=200_000)
def _fold(text: str) -> str:
    return _MN.sub("", unicodedata.normalize("NFD", text.casefold().replace("đ", "d")))


def drawn(text: str) -> tuple[str, list[int] | None]:
    """The drawn characters, and where each stands; None if all are drawn."""
    if not _UNDRAWN.search(text):
        return text, None
    gone = {m.start() for m in _UNDRAWN.finditer(text)}
    return _UNDRAWN.sub("", text), [i for i in range(len(text)) if i not in gone]


class Place:
    """A place where a sentence may end, with what is known around it."""

    __slots__ = ("start", "end", "mark", "closer", "token", "after", "kind", "space", "inside", "lead", "gap", "lower", "left", "right", "features")


def places(text: str) -> list[Place]:
    """Candidates of one paragraph, in order."""
    capitals = [m.start() for m in _CAPITAL.finditer(text)]
    spans, opened = [], []
    # Quotations: (start, end) of those that are closed in this paragraph.
    last_straight = text.rfind('"')
    for m in _QUOTE.finditer(text):
        i, c = m.start(), m.group()
        if c == '"':
            if opened and text[opened[-1]] == '"':
                spans.append((opened.pop(), i))
            elif i < last_straight:
                opened.append(i)
        elif opened and text[opened[-1]] in _PAIRS and c in _PAIRS[text[opened[-1]]]:
            spans.append((opened.pop(), i))
        elif c in _PAIRS and (c != "»" or not opened):
            opened.append(i)
    spans.sort()
    quotes = []  # outermost ones
    for s in spans:
        if not quotes or s[0] > quotes[-1][1]:
            quotes.append(s)
    closing = {b: a for a, b in quotes}
    out, last, at_quote, words, counted = [], 0, 0, 0, 0
    for m in (_CANDIDATE_SPACED if _HAS_SPACED.search(text) else _CANDIDATE).finditer(text):
        start, end = m.span()
        p = Place()
        # No capital around, or none in a long stretch ahead: written without capitals.
        near, ahead = bisect_left(capitals, start - 100), bisect_left(capitals, end)
        lower = near == len(capitals) or capitals[near] > end + 60
        lower |= len(text) > end + 40 and (ahead == len(capitals) or capitals[ahead] > end + 90)
        group = m.group()
        mark = group if group in _MARKS else next((c for c in reversed(group) if c in _MARKS), " ")
        if mark == "." and ".." in group:
            mark = "…"
        p.space = end < len(text) and (text[end].isspace() or mark == " ")
        rest = text[end : end + 80] if mark == " " else text[end : end + 80].lstrip() or text[end:].lstrip()
        if mark != " " and not rest:
            break  # the end of the paragraph needs no decision
        nxt = rest[0]
        if not p.space and mark in ".…" and (nxt in ",;:)-/_" or nxt.islower() and not lower):
            continue
        head = text[max(0, start - 24) : start].rstrip() if mark != " " else text[max(0, start - 24) : start]
        word = head.rsplit(None, 1)[-1] if head[-1:].strip() else ""
        if not word.isalnum():
            word = _BREAK.split(word)[-1]
        p.token = _fold(word)[-14:]
        p.after = _fold(_FIRST.match(rest[:20]).group(1))[:14]
        p.kind = (
            "q" if nxt in _OPEN or nxt in "\"'" else "-" if nxt in "-–—" else "d" if nxt.isdigit() else "U" if nxt.isupper() else "l" if nxt.islower() else "o" if nxt.isalpha() else "p"
        )
        while at_quote < len(quotes) and quotes[at_quote][1] < end:
            at_quote += 1
        p.inside = at_quote < len(quotes) and quotes[at_quote][0] < start and quotes[at_quote][1] >= end
        close = next((i for i in range(end - 1, start - 1, -1) if i in closing), None) if closing and mark != " " else None
        p.lead = ""
        if close is not None:
            intro = text[last : closing[close]].strip()
            p.lead = "^" if not re.search(r"\w", text[max(0, last) : closing[close]]) else ":" if intro[-1:] in ":：" else "," if intro[-1:] in ",，、" else "x"
        p.closer = "q" if close is not None else "b" if group[-1:] in ")]}）】" else ""
        p.mark = "W" if mark in _PLAIN else mark
        p.start, p.end, p.lower = start, end, lower
        if words < 4:
            words += sum(1 for _ in islice(_WORDS.finditer(text, counted, start), 4 - words))
        counted = end
        p.gap = 5 if mark == " " else words  # scripts that set no marks have chains of their own
        p.left, p.right = text[start - 1 : start], nxt
        p.features = ()
        out.append(p)
        if not p.inside:
            last, words = end, 0
    return out


# -- labels by rule, for training


def _url(text: str, at: int) -> bool:
    a, b = at, at
    while a > 0 and not text[a - 1].isspace():
        a -= 1
    while b < len(text) and not text[b].isspace():
        b += 1
    word = text[a:b].rstrip(".!?”\"»)")
    return "www." in word.lower() or "/" in word or "_" in word or "://" in word


def rule_labels(text: str, found: list[Place]) -> list[int]:
    """1 where a sentence ends. Reliable where case and quotation marks are as usual."""
    out, begin = [], 0
    for p in found:
        label = _rule(text, p, text[begin : p.start])
        out.append(label)
        if label:
            begin = p.end
    return out


def _rule(text: str, p: Place, so_far: str) -> int:
    if p.inside:
        return 0
    if p.mark == " ":
        return int(not p.left.isdigit() and not p.right.isdigit())
    goes_on = p.kind in "-" or p.kind == "l" and not p.lower
    if p.closer == "q":
        if p.lead in (":", ","):
            return int(not goes_on)
        return int(p.kind == "U" or p.kind in "qd" and p.lead == "x")
    if goes_on and p.mark != "W":
        return 0
    if p.mark == "…":
        return int(len(re.findall(r"\w+", so_far)) > 1 and not re.fullmatch(r"\W*[^\W\d]{1,4}", so_far))
    if p.mark != ".":
        return 1
    if re.fullmatch(r"\W*\d{1,3}", so_far):  # the number of a list
        return 0
    if not p.space and (_url(text, p.start) or not p.left.islower() and not p.left.isdigit() or p.token in ABBREVIATIONS):
        return 0
    token = p.token.strip(".-")
    pair = "".join(_fold(so_far[-12:]).split())[-3:]
    if token in MAY_END or token.rpartition(".")[2] in MAY_END or pair in ("т.д", "т.п"):
        if p.kind != "U" and p.after in GOES_ON or p.closer == "b":
            return 0
        if token != "д" or pair in ("т.д", "т.п"):
            return 1
    if p.closer == "b":
        return int(p.kind in "Uqo")
    part = token.rpartition(".")[2].rpartition("-")[2]
    if part in ABBREVIATIONS or len(part) == 1 and part.isalpha() or p.after in MONTHS and part.isdigit():
        return 0
    return 1


# -- the model


def _features(p: Place) -> tuple[str, ...]:
    t, m, k = p.token, p.mark, p.kind
    if m == " ":
        side = ("d" if p.left.isdigit() else "o") + ("d" if p.right.isdigit() else "o")
        return ("s", "s" + side)
    shape = (
        "n" if t.isdigit() else "1" if len(t) == 1 else "u" if "/" in t or "_" in t or t.startswith("www") else "." if "." in t else "h" if any(c.isdigit() for c in t) else "a" if len(t) < 5 else "w" if t else "0"
    )
    words = p.gap
    low, gap = "l" if p.lower else "c", "_" if p.space else "+"
    if p.inside:
        return ("in", "in" + m)
    script = unicodedata.name(p.left, "?")[:4] if p.left else "?"
    tail = t.rpartition(".")[2].rpartition("-")[2]
    return (
        m,
        f"t{m}{t}",
        f"u{m}{tail}{p.closer}",
        f"a{m}{p.after}",
        f"tk{m}{t}|{k}{gap}",
        f"ta{t}|{p.after}",
        f"k{m}{k}{gap}{low}{p.closer}",
        f"q{m}{p.closer}{p.lead}{k}{low}",
        f"ql{p.closer}{p.lead}{low}",
        f"h{m}{shape}{k}{gap}{low}",
        f"w{m}{words}{shape}",
        f"x{m}{script}{gap}{p.closer}{p.lead}",
        f"g{gap}{shape}{low}",
    )


class Tagger:
    """Weights of features for an ending, and of pairs of neighbouring decisions."""

    def __init__(self, weights: dict[str, float], pairs: dict[tuple[int, int, int], float]):
        self.weights, self.pairs, self.known = weights, pairs, {}

    def score(self, p: Place) -> float:
        """What speaks for an ending; remembered, as the same words meet around marks again and again."""
        key = (p.token, p.mark, p.kind, p.space, p.lower, p.closer, p.lead, p.after, p.gap, p.inside, p.left, p.right)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            get = self.weights.get
            found = self.known[key] = sum(get(f, 0.0) for f in _features(p))
        return found

    def decode(self, found: list[Place]) -> list[int]:
        """The best sequence of decisions (Viterbi)."""
        if not found:
            return []
        get, pair = self.weights.get, self.pairs.get
        # The start of a paragraph counts as an ending before it.
        inside, ending, back = -1e9, 0.0, []
        for p in found:
            s = sum(get(f, 0.0) for f in p.features) if p.features else self.score(p)
            w = p.gap
            a, b = inside + pair((0, 0, w), 0.0), ending + pair((1, 0, w), 0.0)
            c, d = inside + pair((0, 1, w), 0.0) + s, ending + pair((1, 1, w), 0.0) + s
            back.append((int(b > a), int(d > c)))
            inside, ending = max(a, b), max(c, d)
        label = int(ending > inside)
        out = [0] * len(found)
        for i in range(len(found) - 1, -1, -1):
            out[i] = label
            label = back[i][label]
        return out


def train(paragraphs: list[tuple[list[Place], list[int]]], epochs: int = EPOCHS) -> Tagger:
    """Averaged structured perceptron."""
    weights: dict[str, float] = defaultdict(float)
    pairs: dict[tuple[int, int, int], float] = defaultdict(float)
    sums: dict[str, float] = defaultdict(float)
    pair_sums: dict[tuple[int, int, int], float] = defaultdict(float)
    tagger, step = Tagger(weights, pairs), 1
    for epoch in range(epochs):
        # A fixed stride visits all in another order each time.
        n = len(paragraphs)
        for k in range(n):
            found, gold = paragraphs[(k * (2 * epoch + 1) + epoch * 7919) % n if n % (2 * epoch + 1) else k]
            got = tagger.decode(found)
            if got != gold:
                old_g = old_s = 1
                for p, g, s in zip(found, gold, got):
                    if g != s:
                        for f in p.features:
                            weights[f] += g - s
                            sums[f] += step * (g - s)
                    if (old_g, g) != (old_s, s):
                        w = p.gap
                        for key, sign in (((old_g, g, w), 1), ((old_s, s, w), -1)):
                            pairs[key] += sign
                            pair_sums[key] += step * sign
                    old_g, old_s = g, s
            step += 1
    return Tagger({f: v for f, w in weights.items() if (v := w - sums[f] / step)}, {f: w - pair_sums[f] / step for f, w in pairs.items()})


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _BLANK.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def examples(texts: list[str]) -> list[tuple[list[Place], list[int]]]:
    """Training paragraphs: as they are, in lower case, and stripped of punctuation for scripts without end marks."""
    out = []

    def add(paragraph: str, gold: list[int] | None = None) -> tuple[list[Place], list[int]]:
        found = places(paragraph)
        labels = rule_labels(paragraph, found) if gold is None else gold
        if len(labels) == len(found):
            for p in found:
                p.features = _features(p)
            if found:
                out.append((found, labels))
        return found, labels

    for whole in texts:
        text = drawn(whole)[0]
        cased = any(c.isupper() for c in text)
        if not cased and any(c.islower() for c in text):
            continue  # without capitals the rules aren't sure
        for a, b in _paragraphs(text):
            paragraph = text[a:b]
            if any(c.islower() for c in paragraph) and not any(c.isupper() for c in paragraph):
                continue
            found, labels = add(paragraph)
            if cased:
                small = paragraph.lower()
                if len(small) == len(paragraph):
                    gold = dict(zip((p.end for p in found), labels))
                    # Places that only lower case makes candidates are inside.
                    add(small, [gold.get(p.end, 0) for p in places(small)])
            if re.search(f"[{_SPACED}]", paragraph):
                add(" ".join(re.sub(rf"[.!?…,;:{_WIDE}]+(?!\d)", "", paragraph).split()))
    return out


# Sentences of scripts with marks of their own, each cut at the bars, so that a corpus without them can be cut as well.
WRITTEN = """
Այսօր եղանակը լավ է։| Մենք գնում ենք քաղաք։| Որտե՞ղ է տունը։
ዛሬ ጥሩ ቀን ነው።| ወደ ከተማ እንሄዳለን።| ቤቱ የት ነው፧
ថ្ងៃនេះអាកាសធាតុល្អ។| យើងទៅផ្សារ។| គាត់មកពីភ្នំពេញ។
ဒီနေ့ ရာသီဥတု ကောင်းတယ်။| ကျွန်တော်တို့ ဈေးကို သွားမယ်။| သူ အိမ်မှာ ရှိတယ်။
དེ་རིང་གནམ་གཤིས་ཡག་པོ་འདུག། |ང་ཚོ་ཁྲོམ་ལ་འགྲོ་གི་ཡིན། |ཁོང་ནང་ལ་བཞུགས།
今天天气很好。|我们去市场。|房子在哪里？
今日は暑いです。|山へ行きます。|駅はどこですか？
आज मौसम ठीक है।| हम बाज़ार जाते हैं।| तुम कहाँ हो?
الطقس جميل اليوم.| نحن في السوق.| أين البيت؟
"""


def written(cases: str) -> list[tuple[list[Place], list[int]]]:
    """Training paragraphs out of lines that are cut at bars."""
    out = []
    for line in cases.strip().split("\n"):
        text, ends, at = line.replace("|", ""), set(), 0
        for piece in line.split("|"):
            at += len(piece)
            ends.add(len(text[:at].rstrip()))
        found = places(text)
        for p in found:
            p.features = _features(p)
        out.append((found, [int(p.end in ends) for p in found]))
    return out


def fit(texts: list[str]) -> Tagger:
    return train(examples([t[:TRAINING_CHARACTERS] for t in texts]) + written(WRITTEN) * 20)


def train_model(documents: DataFrame, key: str, text: str) -> Tagger:
    """A tagger for a corpus, from the documents whose hash comes first: the same ones at every run."""
    chosen = documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.substring(text, 1, TRAINING_CHARACTERS).alias("t"), F.xxhash64(key).alias("h"))
    return fit([r.t for r in chosen.orderBy("h", "t").limit(TRAINING_DOCUMENTS).collect()])


def save_model(spark: SparkSession, tagger: Tagger, path: str) -> None:
    """Weights as a table, so that a corpus that grows is trained on once."""
    rows = [(f, 0, 0, 0, w) for f, w in tagger.weights.items()] + [("", *p, w) for p, w in tagger.pairs.items()]
    spark.createDataFrame(rows, "feature string, before int, this int, gap int, weight double").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Tagger:
    rows = spark.read.parquet(path).collect()
    return Tagger({r.feature: r.weight for r in rows if r.feature}, {(r.before, r.this, r.gap): r.weight for r in rows if not r.feature})


def cut(text: str | None, tagger: Tagger) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points of ``text``."""
    if not text:
        return []
    clean, at = drawn(text)
    out = []
    for a, b in _paragraphs(clean):
        paragraph = clean[a:b]
        found = places(paragraph)
        begin = 0
        for end in [*(p.end for p, label in zip(found, tagger.decode(found)) if label), len(paragraph)]:
            piece = paragraph[begin:end]
            body = piece.strip()
            if body:
                first = a + begin + len(piece) - len(piece.lstrip())
                out.append((first, first + len(body)))
            begin = end
    if at is None:
        return out
    whole = []
    for a, b in out:
        start, stop = at[a], at[b - 1] + 1
        while stop < len(text) and _UNDRAWN.match(text[stop]):
            stop += 1
        low = whole[-1][1] if whole else 0
        while start > low and _UNDRAWN.match(text[start - 1]):
            start -= 1
        whole.append((start, stop))
    return whole


def split_sentences(documents: DataFrame, key: str, text: str, model: Tagger | None = None) -> DataFrame:
    """(key, start_char, end_char): every sentence of every document, cut where it is read. Without a ``model`` one is trained first."""
    tagger = model or train_model(documents, key, text)
    sent = documents.sparkSession.sparkContext.broadcast((tagger.weights, tagger.pairs))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*sent.value)
        for batch in batches:
            rows = [(i, a, b) for i, t in enumerate(batch.column(1).to_pylist()) for a, b in cut(t, tagger)]
            if rows:
                i, a, b = zip(*rows)
                yield pa.record_batch([batch.column(0).take(pa.array(i, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64())], [key, "start_char", "end_char"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, start_char long, end_char long")
