"""Queries p10: documents cut into sentences, in any script.

Blank lines, list lines, field lines and headings give units by themselves. Within running text, marks that can end a
sentence (and, in Thai, blanks) are candidates, and a maximum-entropy classifier tells from their surroundings whether
they do: the tokens before and after, their case, length, digits and script, never the amount of space. It is trained on
boundaries that are reliable without it: documents whose writer puts two blanks after a sentence and one elsewhere, how
paragraphs end and start, marks that only end sentences, and continuations in lower case. The training sample is bounded by
``TRAIN_DOCS`` documents of at most ``TRAIN_CHARS`` characters; every document is cut with the same weights.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import spread, table

#: Bounds of the training sample: documents of each kind, and their length.
TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000
#: So many times the sample are drawn by hash before documents are told apart and sorted.
OVERSAMPLE = 15
#: Hashed features of the classifier, passes over the sample and the step.
DIMENSIONS, PASSES, STEP = 1 << 16, 12, 0.3

#: Without a known width, a shorter line is no wrapped one.
SHORT_LINE = 40
ENDS, WIDE_ENDS = ".!?…؟۔।॥", "。！？｡"
CLOSERS = "\"'”’»›」』）)]】》〉"
GOING_ON = ",;，、؛،"
OPENERS = "\"'“‘«‹「『（([【《〈¿¡„"

# Short forms that end in a period, in the languages the classifier meets; it starts from them.
SHORT_FORMS = set(
    "mr mrs ms dr prof st sr jr sra dra srta mme mlle vs etc e.g i.e cf al no nos fig figs sec p pp vol ed eds approx dept est "
    "inc ltd co corp u.n u.s u.k a.m p.m hrs nr abs ca bzw z.b d.h u.a usw vgl hr fr str tel art env núm pág aprox ud uds "
    "av г гг т т.е т.д п пп стр см ул д им руб тыс млн г-н د डॉ".split()
)

_BREAK = "(?:\\r\\n|\\n|\\r|\u2028)"
_BLANK = re.compile(_BREAK + r"(?:[^\S\r\n]*" + _BREAK + r")+[^\S\r\n]*|" + "\u2029")
_LINE = re.compile("\\r\\n|[\\n\\r\u2028]")
_LIST = re.compile(r"[-*•–—▪·◦]\s+\S|\(?\d{1,3}[.)]\s+\S|\(?[a-zA-Z]\)\s+\S")
_BULLET = re.compile(r"[-*•–—▪·◦]\s+\S")
_FIELD = re.compile(r"[^\W\d_][^:：.!?。]{0,30}[:：](?:\s+\S|\s*$)")
_END = re.compile(rf"[{re.escape(ENDS)}]+[{re.escape(CLOSERS)}]*(?=\s|$)|[{re.escape(WIDE_ENDS)}]+[{re.escape(CLOSERS)}]*")
_THAI = re.compile(r"(?<=[฀-๿])\s+(?=\S)|(?<=\S)\s+(?=[฀-๿])")
_THAI_LETTER = re.compile("[\u0e00-\u0e7f]")
_TWO = re.compile(rf"[{re.escape(ENDS)}][{re.escape(CLOSERS)}]*  (?=\S)")
_THAI_TWO = re.compile(r"(?<=[฀-๿])  (?=\S)|(?<=\S)  (?=[฀-๿])")


@lru_cache(maxsize=20_000)
def _kind(c: str) -> str:
    """The class of a character."""
    o = ord(c) if c else 0
    if not c:
        return "none"
    if c.isdigit():
        return "digit"
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    if 0x3040 <= o < 0x30A0:
        return "hira"
    if 0x30A0 <= o < 0x3100:
        return "kata"
    if 0x3400 <= o < 0xA000:
        return "han"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0x590 <= o < 0x780:
        return "arab"
    if 0x900 <= o < 0xE00:
        return "indic"
    if c in OPENERS:
        return "open"
    if c in CLOSERS:
        return "close"
    return "letter" if c.isalpha() else "mark"


_SHAPE = re.compile(r"\d+")


def _token(t: str) -> str:
    return _SHAPE.sub("9", t.lower())


@lru_cache(maxsize=400_000)
def _h(s: str) -> int:
    return zlib.crc32(s.encode())


# Features that the prior knows, and how many there are.
BIAS, SIGN, INITIAL, SHORT, GOES_ON = range(5)
_X, _Y, _MASK = 0x9E3779B1, 0x85EBCA6B, DIMENSIONS - 1


def _place(slot: int, x: int = 0, y: int = 0) -> int:
    """Where a feature stands: its number and the hashes of what it sees, mixed."""
    return ((x + slot) * _X + (y ^ slot) * _Y >> 11) & _MASK


@lru_cache(maxsize=200_000)
def _seen_before(before: str, sign: str) -> tuple:
    """What of the features the token before a mark gives."""
    core = _token(before).lstrip(OPENERS)
    last, end, hb = _h(_kind(before[-1:])), _h(core[-4:]), _h(core + sign)
    initial, short = len(core) == 1 and before[-1:].isupper(), sign == "." and core in SHORT_FORMS
    dots = 2 * ("." in core) + 4 * ("9" in core)
    own = (
        _place(BIAS), _place(INITIAL, initial), _place(SHORT, short), _place(7, last), _place(8, hb), _place(10, end),
        _place(11, min(len(core), 9)), _place(13, _h(_kind(before[:1]))), _place(14, dots),
    )
    return own, last, end, hb


@lru_cache(maxsize=200_000)
def _seen_after(after: str) -> tuple:
    """What of the features the token after a mark gives."""
    a = _token(after)
    bare, kind = a.lstrip(OPENERS), _kind(after.lstrip(OPENERS)[:1])
    first, inner, ha = _h(_kind(after[:1])), _h(kind), _h(bare[:12])
    goes_on = kind in ("lower", "hira") or after[:1] in GOING_ON
    own = (
        _place(GOES_ON, goes_on), _place(5, first), _place(6, inner), _place(9, ha), _place(12, min(len(bare), 9)), _place(23, after[-1:] == "."),
    )
    return own, first, inner, ha, _h(bare[:6]), _h(bare[:4])


def features(before: str, mark: str, after: str, then: str) -> tuple[int, ...]:
    """Hashed features of a candidate: the token before, the mark and what closes it, the token after, the one after that."""
    sign = mark.rstrip(CLOSERS)
    own_b, last, end, hb = _seen_before(before, sign)
    own_a, first, inner, ha, ha6, ha4 = _seen_after(after)
    closed = _h(sign + "c" if len(sign) < len(mark) else sign)
    return (
        *own_b, *own_a, _place(SIGN, closed), _place(15, _h(_kind(then[:1]))), _place(16, hb, inner), _place(17, hb, ha), _place(18, closed, inner),
        _place(19, closed, ha6), _place(20, last, inner), _place(21, end, ha4), _place(22, closed, last ^ (first << 1)),
    )


def _prior():
    """Weights before training: marks end sentences, but not after short forms and initials, nor before lower case."""
    import numpy as np

    w = np.zeros(DIMENSIONS)
    for place, value in (
        (_place(BIAS), 1.5), (_place(INITIAL, True), -3.0), (_place(SHORT, True), -3.0), (_place(GOES_ON, True), -4.0), (_place(SIGN, _h("")), -2.0),
    ):
        w[place] = value
    return w


def fit(rows: list[tuple[tuple[int, ...], bool]]):
    """Maximum entropy by AdaGrad over shuffled batches, drawn to the prior; the same rows give the same weights."""
    import numpy as np

    w = _prior()
    if not rows:
        return w.tolist()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    start, grad2 = w.copy(), np.full(DIMENSIONS, 1e-6)
    rng = np.random.default_rng(0)
    share = {v: max(1, (y == v).sum()) / len(y) for v in (0.0, 1.0)}
    weight = np.where(y == 1, 0.5 / share[1.0], 0.5 / share[0.0]) ** 0.5
    for _ in range(PASSES):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 256):
            k = order[i : i + 256]
            p = 1 / (1 + np.exp(-np.clip(w[x[k]].sum(axis=1), -30, 30)))
            g = np.bincount(x[k].ravel(), np.repeat((p - y[k]) * weight[k], x.shape[1]), DIMENSIONS) / 16
            hit = np.unique(x[k])
            g[hit] += 1e-3 * (w[hit] - start[hit])
            grad2[hit] += g[hit] ** 2
            w[hit] -= STEP * g[hit] / np.sqrt(grad2[hit])
    return w.tolist()


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines."""
    out, at = [], 0
    for m in _BLANK.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def runs(text: str, a: int, b: int, width: int) -> list[tuple[int, int, bool]]:
    """A block's runs: ``(start, end, whole)``; whole runs are units, the others running text over wrapped lines.

    A line break is a wrap if the next line's first word had no room on its line, or if it goes on in lower case.
    """
    lines, at = [], a
    for m in _LINE.finditer(text, a, b):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, b))
    lines = [(s, e) for s, e in lines if text[s:e].strip()]
    if len(lines) == 1:
        s, e = lines[0]
        return [(s, e, _whole(text[s:e].strip()))]
    texts = [text[s:e].strip() for s, e in lines]
    limit = width or max(SHORT_LINE, max(map(len, texts)))
    full = [False] + [_no_room(texts[i - 1], texts[i], limit) for i in range(1, len(lines))] + [False]
    out = []
    for i, (s, e) in enumerate(lines):
        small = texts[i][0].islower() and not _whole(texts[i]) and texts[i - 1].rstrip(CLOSERS)[-1:] not in ENDS + WIDE_ENDS
        goes_on = bool(out) and not out[-1][2] and (full[i] or small)
        bullet = _BULLET.match(texts[i]) is not None
        # a date or a colon within wrapped text makes neither a list nor a field
        whole = bullet or _whole(texts[i]) and not goes_on and not (width and full[i + 1])
        if goes_on and not whole:
            out[-1] = (out[-1][0], e, False)
        else:
            out.append((s, e, whole))
    return out


def _no_room(line: str, after: str, limit: int) -> bool:
    """Whether the next line's first word had no room on this line; in scripts without spaces, its first character.

    A line that is a little wider than the others is full, too."""
    word = after.split(None, 1)[0]
    return len(line) + 1 + len(word) > limit or (word[0] >= "\u2e80" and len(line) + 2 > limit)


def _whole(line: str) -> bool:
    """Whether a line is a unit by its form: a list line, or a short field line that doesn't end like a sentence."""
    if _LIST.match(line):
        return True
    ended = line.rstrip(CLOSERS)[-1:] in ENDS + WIDE_ENDS
    m = None if ended or len(line) > 80 else _FIELD.match(line)
    return m is not None and len(re.split("[:：]", line, maxsplit=1)[0].split()) <= 3


def line_width(text: str) -> int:
    """The width to which a text is wrapped, 0 if it isn't: the one that explains most of its line breaks.

    A break is explained by the widths that hold the line, but not the next line's first word as well.
    """
    lines, n, change = [x.strip() for x in _LINE.split(text)], 0, {}
    for line, after in zip(lines, lines[1:]):
        if line and after:
            n += 1
            if 30 <= len(line) <= 160:
                change[len(line)] = change.get(len(line), 0) + 1
                end = len(line) + 1 + len(after.split(None, 1)[0])
                change[end] = change.get(end, 0) - 1
    best = width = now = 0
    for w in sorted(change):
        now += change[w]
        if now > best:
            best, width = now, w
    return width if best >= 2 and best >= 0.6 * n else 0


def has_thai(text: str) -> bool:
    return not text.isascii() and _THAI_LETTER.search(text) is not None


def candidates(text: str, s: int, e: int, thai: bool):
    """``(mark, end, next start)`` of all places in a run of text where a sentence may end, but its end."""
    seen = []
    for m in _END.finditer(text, s, e):
        seen.append((m.end(), m.start()))
    if thai:
        marks = {x for x, _ in seen}
        seen += [(m.start(), m.start()) for m in _THAI.finditer(text, s, e) if m.start() not in marks]
        seen.sort()
    for end, mark in seen:
        nxt = end
        while nxt < e and text[nxt].isspace():
            nxt += 1
        if nxt >= e:
            continue
        opens = nxt > end and text[nxt] in OPENERS and not text[nxt + 1 : nxt + 2].isspace()
        if opens or text[nxt] not in CLOSERS + ".:!?":
            yield mark, end, nxt


_WORD = re.compile(r"\S+")


def surroundings(text: str, s: int, e: int, mark: int, end: int, nxt: int) -> tuple[int, ...]:
    """The features of a candidate; words of scripts without spaces are cut to a few characters."""
    lo = max(s, mark - 24)
    before = text[lo:mark].rstrip().rsplit(None, 1)[-1:] or [""]
    m = _WORD.match(text, nxt, min(e, nxt + 24))
    after = m.group() if m else ""
    m = _WORD.search(text, m.end(), min(e, m.end() + 6)) if m else None
    cut_b = before[0][-6:] if "฀" <= before[0][-1:] else before[0]
    cut_a = after[:6] if "฀" <= after[:1] else after
    return features(cut_b, text[mark:end], cut_a, m.group() if m else "")


def wide(text: str) -> bool:
    """Whether the writer puts two blanks between sentences."""
    return "  " in text and len(_TWO.findall(text)) + (len(_THAI_TWO.findall(text)) if has_thai(text) else 0) >= 3


def _edge(token: str, last: bool) -> str:
    """A token at the edge of a sentence in a script without marks: six letters of that script, else a class."""
    end = token[-1:] if last else token[:1]
    if "\u0e00" <= end < "\u0e80":
        return token[-6:] if last else token[:6]
    return _kind(end)


def paragraph_edges(text: str) -> tuple[list[str], list[str]]:
    """How paragraphs of Thai end and start: what sentences of a script without marks end and start with."""
    ends, starts = [], []
    for a, b in blocks(text):
        words = text[a:b].split()
        if any("\u0e00" <= w[0] < "\u0e80" or "\u0e00" <= w[-1] < "\u0e80" for w in (words[0], words[-1])):
            ends.append(_edge(words[-1], True))
            starts.append(_edge(words[0], False))
    return ends, starts


def reliable(text: str, ends: frozenset = frozenset(), starts: frozenset = frozenset()) -> list[tuple[tuple[int, ...], bool]]:
    """Labelled candidates of a text, from reliable boundaries only. ends, starts: how paragraphs without marks do."""
    out, parts, two, width, thai = [], blocks(text), wide(text), line_width(text), has_thai(text)
    for i, (a, b) in enumerate(parts):
        for s, e, whole in runs(text, a, b, width):
            if whole:
                continue
            for mark, end, nxt in candidates(text, s, e, thai):
                gap, f = text[end:nxt], surroundings(text, s, e, mark, end, nxt)
                closed = text[end - 1] in CLOSERS
                if mark == end and not two:
                    words = text[s:mark].rsplit(None, 1)[-1:], text[nxt : nxt + 24].split(None, 1)[:1]
                    if ends and words[0] and words[1]:
                        out.append((f, _edge(words[0][0], True) in ends and _edge(words[1][0], False) in starts))
                elif two and set(gap) == {" "}:
                    out.append((f, len(gap) > 1))
                elif closed and (text[nxt].islower() or _kind(text[nxt]) == "hira" or text[nxt] in ",，、"):
                    out.append((f, False))
                elif text[mark] == "." and gap and text[nxt].islower():
                    out.append((f, False))
                elif text[mark] in WIDE_ENDS and not closed:
                    out.append((f, True))
        # the end of a paragraph, seen before the start of the next one
        tail = text[a:b].rstrip()
        m = None
        for m in _END.finditer(tail, max(0, len(tail) - 12)):
            pass
        if m and m.end() == len(tail) and i + 1 < len(parts):
            after = text[parts[i + 1][0] : parts[i + 1][1]].lstrip()
            joined = tail[-60:] + " " + after[:40]
            cut = len(tail[-60:])
            mark = cut - (len(tail) - m.start())
            out.append((surroundings(joined, 0, len(joined), mark, cut, cut + 1), True))
    return out


def units(text: str, weights) -> list[tuple[int, int]]:
    """``(start, end)`` of the units of a text, white space left out."""
    out, two, width, thai = [], wide(text), line_width(text), has_thai(text)
    for a, b in blocks(text):
        for s, e, whole in runs(text, a, b, width):
            at = s
            if not whole:
                for mark, end, nxt in candidates(text, s, e, thai):
                    gap = text[end:nxt]
                    sure = two and len(gap) > 1 and set(gap) == {" "}
                    if sure or sum(map(weights.__getitem__, surroundings(text, s, e, mark, end, nxt))) > 0:
                        out.append((at, end))
                        at = nxt
            out.append((at, e))
    trimmed = []
    for s, e in out:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            trimmed.append((s, e))
    return trimmed


def train(docs: DataFrame, text: str = "text", n_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS):
    """Weights from a bounded sample: up to ``n_docs`` wide-spaced documents and as many of the others, by hash order."""
    total = docs.count()
    hashed = docs.select(F.col(text).alias("t"), F.xxhash64(text).alias("h")).where(F.char_length("t").between(1, max_chars))
    # a share of the documents by hash, so that no task sends more than it has to; the few that pass are sorted
    share = min(1.0, OVERSAMPLE * n_docs / max(total, 1))
    drawn = hashed.where(F.pmod(F.xxhash64(F.lit(7), "h"), F.lit(1_000_000)) < int(1_000_000 * share))
    twice = F.regexp_count("t", F.lit(f"[{ENDS}]" + r"[\"'”’»›)\]]*  \S|[\x{e00}-\x{e7f}]  \S")) >= 3
    kinds = drawn.select("t", "h", twice.alias("twice"))
    texts = []
    for cond in (F.col("twice"), ~F.col("twice")):
        texts += [r.t for r in kinds.where(cond).orderBy("h", "t").select("t").limit(n_docs).collect()]
    return fit(labelled(texts))


def labelled(texts: list[str]) -> list[tuple[tuple[int, ...], bool]]:
    """The reliable candidates of all texts."""
    edges = [paragraph_edges(t) for t in texts if "\u0e00" <= max(t, default="")]
    ends, starts = frozenset(x for e, _ in edges for x in e), frozenset(x for _, e in edges for x in e)
    return [row for t in texts for row in reliable(t, ends, starts)]


def split_units(docs: DataFrame, weights, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``start_char``, ``end_char``: the units of every document; null, empty and blank texts have none.

    Offsets count code points from 0 in the text as stored, end exclusive. Repeated rows give their units once.
    """
    known = docs.sparkSession.sparkContext.broadcast(weights)
    kind = dict(docs.select(doc_id).dtypes)[doc_id]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, spans = [], []
            for t in batch.column("t").to_pylist():
                u = units(t, known.value)
                n.append(len(u))
                spans += u
            rows = pa.array(np.repeat(np.arange(len(n)), n))
            flat = np.array(spans, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())],
                names=["doc_id", "start_char", "end_char"],
            )

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("t is not null and trim(t) <> ''")
    return spread(source).mapInArrow(run, f"doc_id {kind}, start_char long, end_char long")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return split_units(docs, train(docs)).distinct()


def p10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per document and their mean length, by language as stored."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    u = p10_found(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars")
    )
    return d.join(u, "doc_id").groupBy("lang").agg(F.sum("n").alias("n_units"), (F.sum("chars") / F.sum("n")).alias("mean_chars"))


QUERIES = {"p10_found": p10_found, "p10_lengths": p10_lengths}
SQL: dict[str, str] = {}
