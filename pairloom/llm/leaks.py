"""Queries p9: evaluation texts that leak into training text.

Texts become tokens that don't depend on case, punctuation, spacing or look-alike characters: words, and single
characters in scripts without spaces. Every window of half a passage's size gets a 64-bit SimHash, in the items as in the
documents; a passage with an odd changed word still has a window without it. The items' fingerprints are cut into
``RADIUS + 1`` blocks, so two fingerprints within the radius agree on one block: looking up all blocks of a document's
window finds every item window within the radius. Candidates are verified exactly: the item's shingles of two tokens are
looked up in the document's text around the window, and some passage of the item must be covered by them, as to its
words or letters and as to the weight of its shingles. A shingle weighs more the fewer documents have it, counted over all
documents while they are read, which tells a copied passage from the stock phrases that texts of a kind share.

The items are the query set. They are broadcast in blocks of bounded size, each against all documents; a document is
read once per block and never leaves its task. What comes back are counts of the items' shingles and the few candidates.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.textforms import python_forms
from pairloom.session import Scratch, spread, table

#: Tokens of a window, in spaced text and where half of the tokens or more are single characters.
WINDOW, CHAR_WINDOW = 8, 10
RADIUS = 3
#: A passage weighs 1 if it has sixteen words, or forty letters and digits in scripts without spaces.
WORDS, LETTERS = 16, 40
#: Least weight of what a passage's shingles cover, least after the weight of what they don't cover is taken off, and the
#: least share of its shingles' rarity.
MATCHED, NET, SIMILAR = 0.85, 0.7, 0.75
#: A text counts letters where this share of its tokens or more are characters of scripts without spaces.
UNSPACED_SHARE = 0.3
#: Characters of items that one broadcast index may hold.
BLOCK_CHARS = 20_000_000
#: Tokens whose windows are hashed at once.
CHUNK = 60_000

UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"


@lru_cache
def _patterns():
    import regex

    token = regex.compile(rf"[{UNSPACED}]\p{{M}}*|[[\p{{L}}\p{{N}}\p{{M}}]--[{UNSPACED}]]+", regex.V1)
    return token, regex.compile(rf"[{UNSPACED}]", regex.V1)


_HASHES: dict[str, int] = {}


@lru_cache
def _special():
    """Characters whose form differs, a pattern of plain words, and the characters of texts for which it will do."""
    import re

    scripts = [*range(0x300), *range(0x370, 0x483), *range(0x48A, 0x590)]
    signs = [*range(0x2010, 0x205F), *range(0x20A0, 0x20C0), *range(0x2190, 0x2C00), *range(0x1F000, 0x20000), 0xFE0F, 0x200D]
    return frozenset(chr(c) for c in python_forms() if c >= 0x80), re.compile(r"[^\W_]+"), frozenset(map(chr, scripts + signs))


def tokens(text: str) -> list[str]:
    """The tokens of a text, in one form for all writings."""
    import unicodedata

    special, words, plain = _special()
    if text.isascii():
        return words.findall(text.lower())
    used = set(text)
    if not special.isdisjoint(used):
        text = text.translate(python_forms())
        used = set(text)
    if used <= plain:
        return words.findall(text.casefold())
    return _patterns()[0].findall(unicodedata.normalize("NFC", text).casefold())


def hashes(toks: list[str]):
    import numpy as np
    import xxhash

    if len(_HASHES) > 2_000_000:
        _HASHES.clear()
    out = np.empty(len(toks), np.uint64)
    get = _HASHES.get
    for i, t in enumerate(toks):
        h = get(t)
        if h is None:
            h = _HASHES[t] = xxhash.xxh3_64_intdigest(t)
        out[i] = h
    return out


def single(toks: list[str], text: str):
    """Which of a text's tokens are single characters of scripts without spaces."""
    import numpy as np

    if not text or text.isascii() or max(text) < "\u0e00":
        return np.zeros(len(toks), bool)
    return np.fromiter((t[0] > "฀" and _patterns()[1].match(t) is not None for t in toks), bool, len(toks))


def running_bits(h):
    """For each of 64 bits in how many of the token hashes up to here it is set."""
    import numpy as np

    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    total = np.zeros((len(h) + 1, 64), np.uint16)  # differences of neighbours are right even where it wraps
    np.cumsum(bits, axis=0, dtype=np.uint16, out=total[1:])
    return total


def simhashes(total, size: int, start):
    """SimHash of the runs of ``size`` tokens at the given starts: the bits that more than half of the tokens have."""
    import numpy as np

    return np.packbits(2 * (total[start + size] - total[start]) > size, axis=1).view("<u8").ravel()


def fingerprints(h, one, owner):
    """``(position, fingerprint)`` of all windows that lie in one text: of the size that their kind of tokens asks for."""
    import numpy as np

    chars = np.concatenate([[0], np.cumsum(one)])
    at, prints, total = [], [], running_bits(h)
    for size in (WINDOW, CHAR_WINDOW):
        if len(h) < size:
            continue
        start = np.arange(len(h) - size + 1)
        inside = owner[start] == owner[start + size - 1]
        end = np.minimum(start + WINDOW, len(h))
        many = 2 * (chars[end] - chars[start]) >= WINDOW
        keep = inside & (many == (size == CHAR_WINDOW))
        if keep.any():
            at.append(start[keep])
            prints.append(simhashes(total, size, start[keep]))
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(at), np.concatenate(prints)


def token_weights(text: str, toks: list[str], one):
    """The weight of each token of an item: letters count where its script has no spaces, words elsewhere."""
    import numpy as np

    if len(toks) and one.mean() >= UNSPACED_SHARE:
        return np.array([len(t) for t in toks], float) / LETTERS
    weights, at = np.zeros(len(toks)), 0
    for chunk in text.split():
        n = len(tokens(chunk))
        weights[at : at + n] = 1 / (WORDS * max(n, 1))
        at += n
    if at != len(toks):
        weights[:] = 1 / WORDS
    return weights


def build_index(items: list[tuple[int, str]]) -> dict:
    """Shingles, weights and fingerprints of the items, and for each block of bits the windows that have each value."""
    import numpy as np

    kept, owner_of, pos_of, prints = [], [], [], []
    for item_id, text in items:
        toks = tokens(text or "")
        h, one = hashes(toks), single(toks, text or "")
        at, fp = fingerprints(h, one, np.zeros(len(h), np.int8))
        if len(at):
            owner_of.append(np.full(len(at), len(kept)))
            pos_of.append(at)
            prints.append(fp)
            kept.append((item_id, shingles(h), token_weights(text, toks, one)))
    if not kept:
        return {"items": [], "known": np.empty(0, np.uint64)}
    fp = np.concatenate(prints)
    width = 64 // (RADIUS + 1)
    blocks = []
    for b in range(RADIUS + 1):
        value = (fp >> np.uint64(b * width)) & np.uint64((1 << width) - 1)
        order = np.argsort(value, kind="stable")
        first = np.searchsorted(value[order], np.arange((1 << width) + 1, dtype=np.uint64))
        blocks.append((order, first))
    known = np.unique(np.concatenate([k[1] for k in kept]))
    return {"items": kept, "known": known, "owner": np.concatenate(owner_of), "pos": np.concatenate(pos_of), "fp": fp, "blocks": blocks, "width": width}


def lookup(index: dict, fp):
    """``(document window, item window)`` of all fingerprints within the radius."""
    import numpy as np

    a_all, b_all = [], []
    mask = np.uint64((1 << index["width"]) - 1)
    for b, (order, first) in enumerate(index["blocks"]):
        value = ((fp >> np.uint64(b * index["width"])) & mask).astype(np.int64)
        n = first[value + 1] - first[value]
        a = np.repeat(np.arange(len(fp)), n)
        if not len(a):
            continue
        inner = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        w = order[np.repeat(first[value], n) + inner]
        near = np.bitwise_count(fp[a] ^ index["fp"][w]) <= RADIUS
        a_all.append(a[near])
        b_all.append(w[near])
    if not a_all:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a_all), np.concatenate(b_all)


def shingles(h):
    """Hashes of each two neighbouring tokens."""
    import numpy as np

    return (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x7F4A7C15)) if len(h) > 1 else h[:0]


def meetings(doc, item, weights, starts):
    """Which of the item's shingles the document has, for each region where windows met and enough is covered.

    starts: where windows met, ``(i, j)``; a region reaches from there over the whole item and a quarter more.
    """
    import numpy as np

    m, seen = len(weights), []
    for i, j in starts:
        lo, hi = max(0, i - j - m // 4 - 4), i + (m - j) + m // 4 + 4
        if not any(a <= lo and hi <= b for a, b in seen):
            seen.append((lo, hi))
            met = np.isin(item, doc[lo : hi - 1])
            if passage(met, weights, np.zeros(len(met))):
                yield met


def passage(met, weights, rarity) -> bool:
    """Whether some run of the item's tokens is like the document's: what its shingles cover weighs ``MATCHED`` or more,
    ``NET`` less what they don't cover, and they have ``SIMILAR`` of the run's rarity or more."""
    import numpy as np

    have = np.zeros(len(weights), bool)
    have[:-1] |= met
    have[1:] |= met
    if weights[have].sum() < MATCHED:
        return False
    total = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    run = lambda c, d: d[None, :] - c[:, None]
    mass, net = total(np.where(have, weights, 0.0)), total(np.where(have, weights, -weights.mean()))
    # from token a to token b; the shingles of such a run are one fewer
    spare = total(np.where(met, (1 - SIMILAR) * rarity, -SIMILAR * rarity))
    enough = (run(mass, mass) >= MATCHED - 1e-9) & (run(net, net) >= NET - 1e-9)
    return bool((enough[:-1, 1:] & (run(spare, spare) >= -1e-9)).any())


def candidates(index: dict, ids: list, texts: list[str | None], counts):
    """``(id, item, met)`` of documents of a batch with the places of the items they may leak and the shingles they share.

    ``counts`` is raised by one for each known shingle that a text (of a very long one, a chunk) has.
    """
    import numpy as np

    docs, known = [], index["known"]

    def flush():
        if not docs:
            return
        h = np.concatenate([d[1] for d in docs])
        one = np.concatenate([d[2] for d in docs])
        sizes = [len(d[1]) for d in docs]
        owner = np.repeat(np.arange(len(docs)), sizes)
        own = shingles(h)
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = (known[place] == own) & (owner[:-1] == owner[1:]) if len(own) else np.zeros(0, bool)
        each = np.unique(owner[:-1][hit] * len(known) + place[hit])
        counts[:] += np.bincount(each % len(known), minlength=len(known))
        at, fp = fingerprints(h, one, owner)
        a, w = lookup(index, fp)
        base = np.cumsum([0, *sizes])
        pairs: dict[tuple[int, int], set] = {}
        for x, y in zip(at[a].tolist(), w.tolist(), strict=True):
            k = int(owner[x])
            i, j = x - int(base[k]) + docs[k][3], int(index["pos"][y])
            pairs.setdefault((k, int(index["owner"][y])), set()).add((i, j))
        for (k, o), starts in pairs.items():
            _, item, weights = index["items"][o]
            for met in meetings(docs[k][4], item, weights, sorted(starts)):
                yield docs[k][0], o, np.packbits(met).tobytes()
        docs.clear()

    n = 0
    for doc_id, text in zip(ids, texts, strict=True):
        toks = tokens(text) if text else []
        h, one = hashes(toks), single(toks, text or "")
        whole = shingles(h)
        for lo in range(0, max(len(h) - WINDOW + 1, min(len(h), 1)), CHUNK):
            hi = lo + CHUNK + CHAR_WINDOW
            docs.append((doc_id, h[lo:hi], one[lo:hi], lo, whole))
            n += len(h[lo:hi])
            if n >= CHUNK:
                yield from flush()
                n = 0
    yield from flush()


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``doc_id``, ``item_id``: documents with a passage of an item of about sixteen words or forty letters, or more.

    Null and empty texts hold nothing, nor do items too short for a window. Several equal rows give one. Very long texts
    are read whole, in overlapping chunks. The number of blocks that the items are cut into doesn't change the result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "leaks")
    kinds = dict(docs.select(doc_id).dtypes)[doc_id], dict(items.select(item_id).dtypes)[item_id]
    own = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    n_blocks = 1 + (own.agg(F.sum(F.char_length("text"))).first()[0] or 0) // block_chars
    source = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''"))
    out = None
    for b in range(n_blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        part = _leaks_of(source, kinds, build_index([tuple(r) for r in rows]), scratch)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _leaks_of(source: DataFrame, kinds: tuple[str, str], index: dict, scratch: Scratch) -> DataFrame:
    """The leaks of one block of items. Documents are read once, for the candidates and for the counts of shingles."""
    import numpy as np

    spark = source.sparkSession
    known = spark.sparkContext.broadcast(index)

    def read(batches):
        import pyarrow as pa

        idx, n_texts = known.value, 0
        counts = np.zeros(len(idx["known"]), np.int64)
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            n_texts += batch.num_rows
            if idx["items"]:
                got = list(candidates(idx, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), counts))
                if got:
                    d, o, met = zip(*got, strict=True)
                    none = pa.nulls(len(got), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(d, doc_type), pa.array(o, pa.int32()), pa.array(met, pa.binary()), none, none], names=names)
        if doc_type is not None:
            place = np.append(np.nonzero(counts)[0], -1)
            n, none = np.append(counts[counts > 0], n_texts), len(place)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(none, doc_type), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.array(place.astype(np.int64)), pa.array(n.astype(np.int64))], names=names
            )

    names = ["doc_id", "item", "met", "place", "n"]
    hits = scratch.save(source.mapInArrow(read, f"doc_id {kinds[0]}, item int, met binary, place long, n long"), "hits")
    counts = np.ones(len(index["known"]), np.int64)
    n_texts = 0
    # one count for each shingle of the block's items, so bounded as they are
    for r in hits.where("place is not null").groupBy("place").agg(F.sum("n").alias("n")).collect():
        if r.place < 0:
            n_texts = r.n
        else:
            counts[r.place] = r.n
    rarity = spark.sparkContext.broadcast(np.log((n_texts + 1) / counts) ** 2)

    def verify(batches):
        import pyarrow as pa

        idx = known.value
        for batch in batches:
            keep, found = [], []
            for o, met in zip(batch.column("item").to_pylist(), batch.column("met").to_pylist(), strict=True):
                item_id, item, weights = idx["items"][o]
                bits = np.unpackbits(np.frombuffer(met, np.uint8), count=len(item)).astype(bool)
                keep.append(passage(bits, weights, rarity.value[np.searchsorted(idx["known"], item)]))
                found.append(item_id)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, id_type)], names=["doc_id", "item_id"]).filter(pa.array(keep, pa.bool_()))

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(spark.createDataFrame([], f"x {kinds[1]}").schema[0].dataType)
    return hits.where("met is not null").select("doc_id", "item", "met").mapInArrow(verify, f"doc_id {kinds[0]}, item_id {kinds[1]}")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: its benchmark and the number of documents and sources that leak it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = p9_found(spark, sf_dir).join(d, "doc_id")
    n = found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("source").alias("n_sources"))
    return table(spark, sf_dir, "eval_items").select("item_id", "benchmark").join(n, "item_id", "left").na.fill(0, ["n_docs", "n_sources"])


QUERIES = {"p9_found": p9_found, "p9_report": p9_report}
SQL: dict[str, str] = {}
