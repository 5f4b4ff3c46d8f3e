"""Quality rules by distribution divergence.

Each language gets a reference: the mean character-class histogram of its
documents and the histogram of its common words (words that make up at least
1/200 of its running words, so never more than 200 of them). A document is
kept when the Jensen-Shannon distance to its language's reference stays under
a fixed limit for both histograms. Short texts are not judged on a histogram
they are too short to fill: below `MIN_CHARS` code points or `MIN_WORDS` words
the distance is reported but rejects nothing.

References are computed over every document, one for each language that has
`MIN_LANGUAGE_WORDS` words, whatever the size of the rest. Those of languages
with at least 1/1000 of the corpus's words are broadcast, so at most 1000; the
others are a table that is joined to their documents. A language with less
text, and a null language, has no reference: the distances from the whole
corpus are reported but reject nothing.

Defined cases: null text = empty text (no words, base_failed, not kept);
repeated rows each get their own equal verdict; an empty table gives an empty
result; columns of the input other than doc_id, text and lang are ignored by
the query and carried unchanged by `quality_rules`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._store import discard, read_table, settle
from siltstone.llm._text import LOWER, SPACE, Words, chunks, combine, prefix_hash, runs, span_hash

MIN_CHARS, MIN_WORDS = 200, 50
CHAR_LIMIT, WORD_LIMIT = 0.30, 0.40
COMMON_SHARE, LANGUAGE_SHARE = 200, 1000
#: With fewer words a common word would occur under ten times in the reference.
MIN_LANGUAGE_WORDS = 10 * COMMON_SHARE
FLUSH_WORDS = 2_000_000

#: Character classes: lower, upper, digit, space, punctuation, emphasis, symbol, beyond ASCII; 8 = skipped.
N_CLASSES = 8
CLASS = np.full(256, 6, dtype=np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[SPACE] = 3
for _c in b".,;:'\"-()":
    CLASS[_c] = 4
for _c in b"!?":
    CLASS[_c] = 5
CLASS[128:] = 7
CLASS[0x80:0xC0] = 8
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
LEAD = (np.arange(256) & 0xC0) != 0x80


def class_counts(chunk) -> np.ndarray:
    docs = np.repeat(np.arange(len(chunk)), np.diff(chunk.offsets))
    flat = np.bincount(docs * 9 + CLASS[chunk.data], minlength=9 * len(chunk))
    return flat.reshape(len(chunk), 9)[:, :N_CLASSES]


def word_keys(chunk, words: Words) -> np.ndarray:
    return span_hash(prefix_hash(LOWER[chunk.data]), words.start, words.end).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n): counts of word keys, and under key -1-class the summed class shares in millionths."""
    keys: dict[str | None, list[np.ndarray]] = {}
    shares: dict[str | None, np.ndarray] = {}
    held = 0

    def flush():
        for lang, parts in keys.items():
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(key), pa.string()), pa.array([False] * len(key)), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "is_class", "key", "n"])
        for lang, total in shares.items():
            yield pa.record_batch([pa.array([lang] * N_CLASSES, pa.string()), pa.array([True] * N_CLASSES), pa.array(np.arange(N_CLASSES)), pa.array(total)], names=["lang", "is_class", "key", "n"])
        keys.clear()
        shares.clear()

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for chunk in chunks(batch.column("text")):
            words = Words(chunk)
            key, docs = word_keys(chunk, words), words.docs()
            counts = class_counts(chunk)
            total = counts.sum(axis=1, keepdims=True)
            share = (1_000_000 * counts) // np.maximum(total, 1)
            own = langs[chunk.lo : chunk.hi]
            for lang in set(own.tolist()):
                mine = np.array([x == lang for x in own], dtype=bool)
                keys.setdefault(lang, []).append(key[mine[docs]])
                shares[lang] = shares.get(lang, np.zeros(N_CLASSES, dtype=np.int64)) + share[mine & (total[:, 0] >= MIN_CHARS)].sum(axis=0)
            held += len(key)
            if held >= FLUSH_WORDS:
                yield from flush()
                held = 0
    yield from flush()


def _reference(pairs: list, by_class: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs.sort()
    share = np.array([by_class.get(c, 0) for c in range(N_CLASSES)], dtype=float)
    return share / max(share.sum(), 1), np.array([k for k, _ in pairs], dtype=np.int64), np.array([s for _, s in pairs], dtype=float)


def references(docs: DataFrame) -> tuple[dict, DataFrame | None]:
    """Language -> (class shares, sorted common word keys, their shares), None -> the whole corpus; and a table (_lang, _words, _classes) of the smaller languages, if there are any."""
    counted = (
        docs.select("text", F.col("lang").cast("string").alias("lang"))
        .mapInArrow(_count, "lang string, is_class boolean, key long, n long")
        .groupBy("lang", "is_class", "key").agg(F.sum("n").alias("n"))
    )
    counted = settle(counted, "language-words")
    totals = counted.groupBy("lang", "is_class").agg(F.sum("n").alias("total"))
    words = totals.filter("not is_class").agg(F.sum("total")).first()[0] or 0
    own = totals.filter(F.col("lang").isNotNull() & ~F.col("is_class") & (F.col("total") >= MIN_LANGUAGE_WORDS)).select("lang", "total")
    large, small = own.filter(F.col("total") * LANGUAGE_SHARE >= words), own.filter(F.col("total") * LANGUAGE_SHARE < words)
    pooled = counted.groupBy("is_class", "key").agg(F.sum("n").alias("n"))
    common = pooled.filter(~F.col("is_class") & (F.col("n") * COMMON_SHARE >= words)).select(F.lit(None).cast("string").alias("lang"), "key", "n", F.lit(words).cast("long").alias("total"))
    per_lang = counted.filter("not is_class").join(F.broadcast(large), "lang").filter(F.col("n") * COMMON_SHARE >= F.col("total")).select("lang", "key", "n", "total")
    out: dict = {}
    for lang, key, n, total in common.union(per_lang).collect():  # at most 1001 languages of at most 200 words
        out.setdefault(lang, ([], [], {}))[1].append((key, n / total))
    classes = pooled.filter("is_class").select(F.lit(None).cast("string").alias("lang"), "key", "n").union(
        counted.filter("is_class").join(F.broadcast(large), "lang").select("lang", "key", "n"))
    for lang, key, n in classes.collect():
        out.setdefault(lang, ([], [], {}))[2][key] = n
    joined = None
    if not small.isEmpty():
        entry = F.struct("key", "n", "total")
        mine = counted.join(small, "lang").filter(F.col("is_class") | (F.col("n") * COMMON_SHARE >= F.col("total")))
        joined = settle(mine.groupBy(F.col("lang").alias("_lang")).agg(F.collect_list(F.when(~F.col("is_class"), entry)).alias("_words"), F.collect_list(F.when(F.col("is_class"), entry)).alias("_classes")), "small-languages")
    discard(counted)
    return {lang: _reference(pairs, by_class) for lang, (_, pairs, by_class) in out.items()}, joined


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0..1) of each row of p from q; a row without mass is at 0."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    return np.where(p.sum(axis=-1) > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


def _covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """How many of n entries are inside [start, start+size) of any start: a 0/1 array."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + size, n), -1)
    return np.cumsum(delta[:-1]) > 0


def measures(chunk) -> dict[str, np.ndarray]:
    """The base measures of each document of a chunk, and what the distances need."""
    words = Words(chunk)
    n_words = words.counts()
    hashes = span_hash(prefix_hash(chunk.data), words.start, words.end)
    starts, docs = runs(words.bounds, 3)
    windows = combine(hashes, 3)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
    repeated = np.zeros(len(words), dtype=bool)
    if len(starts) > 1:
        order = np.lexsort((windows, docs))
        same = (windows[order][1:] == windows[order][:-1]) & (docs[order][1:] == docs[order][:-1])
        twice = np.zeros(len(starts), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        repeated = _covered(starts[twice], 3, len(words))
    in_words = np.concatenate(([0], np.cumsum(repeated)))
    dup_lines = np.zeros(len(chunk), dtype=np.int64)
    for i in range(len(chunk)):
        seen: set[bytes] = set()
        for line in chunk.raw(i).split(b"\n"):
            if line.strip(b" \t\n\x0b\x0c\r"):
                if line in seen:
                    dup_lines[i] += 1
                else:
                    seen.add(line)
    return {
        "words": words, "n_words": n_words, "word_chars": chunk.per_doc(LEAD[chunk.data] & ~SPACE[chunk.data]),
        "n_symbols": chunk.per_doc(SYMBOL[chunk.data]), "n_dup_lines": dup_lines,
        "n_repeat_words": in_words[words.bounds[1:]] - in_words[words.bounds[:-1]],
    }


def distances(chunk, words: Words, langs: np.ndarray, refs: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By class, by word, code points, and whether the language has a reference of its own."""
    counts = class_counts(chunk)
    n_chars = counts.sum(axis=1)
    shares = counts / np.maximum(n_chars, 1)[:, None]
    key, docs = word_keys(chunk, words), words.docs()
    by_class, by_word = np.zeros(len(chunk)), np.zeros(len(chunk))
    own = np.array([x if x in refs else None for x in langs], dtype=object)
    for lang in set(own.tolist()):
        if lang not in refs:
            continue
        mine = np.array([x == lang for x in own], dtype=bool)
        class_ref, common, common_ref = refs[lang]
        by_class[mine] = js_distance(shares[mine], class_ref)
        if not len(common):
            continue
        row = np.cumsum(mine) - 1
        here = mine[docs]
        slot = np.minimum(np.searchsorted(common, key[here]), len(common) - 1)
        slot = np.where(common[slot] == key[here], slot, len(common))
        width = len(common) + 1
        table = np.bincount(row[docs[here]] * width + slot, minlength=width * int(mine.sum())).reshape(-1, width)
        ref = np.append(common_ref, max(0.0, 1 - common_ref.sum()))
        by_word[mine] = js_distance(table / np.maximum(table.sum(axis=1, keepdims=True), 1), ref)
    return by_class, by_word, n_chars, np.array([x is not None for x in own], dtype=bool)


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"


def _judge(refs, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = refs.value
            langs = np.array(batch.column("_lang").to_pylist(), dtype=object)
            if "_words" in batch.schema.names:
                table = dict(table)
                for i, lang in enumerate(langs.tolist()):
                    if lang not in table and batch.column("_classes")[i].is_valid:
                        words, classes = (batch.column(c)[i].as_py() for c in ("_words", "_classes"))
                        table[lang] = _reference([(x["key"], x["n"] / x["total"]) for x in words], {x["key"]: x["n"] for x in classes})
            for chunk in chunks(batch.column("_text")):
                m = measures(chunk)
                by_class, by_word, n_chars, judged = distances(chunk, m["words"], langs[chunk.lo : chunk.hi], table)
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                odd = judged & (((n_chars >= MIN_CHARS) & (by_class > CHAR_LIMIT)) | ((m["n_words"] >= MIN_WORDS) & (by_word > WORD_LIMIT)))
                kept = ~failed & ~odd
                rows = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                if carry:
                    row = rows.column("row")
                    yield pa.RecordBatch.from_arrays(row.flatten(), names=[f.name for f in row.type]).filter(pa.array(kept))
                else:
                    columns = [m[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                    yield pa.record_batch([rows.column("doc_id"), *map(pa.array, [*columns, by_class, by_word, failed, kept])], names=[x.split()[0] for x in VERDICT.split(", ")])

    return run


def _judged(plain: DataFrame, docs: DataFrame, carry: bool, schema) -> DataFrame:
    """plain (with _text and _lang) judged by the references of docs (text, lang)."""
    large, small = references(docs)
    judge = _judge(plain.sparkSession.sparkContext.broadcast(large), carry)
    if small is None:
        return plain.mapInArrow(judge, schema)
    at_hand = F.col("_lang").isNull() | F.col("_lang").isin([x for x in large if x is not None])
    joined = plain.filter(~at_hand).join(small, "_lang", "left").select(*plain.columns, "_words", "_classes")
    return plain.filter(at_hand).mapInArrow(judge, schema).unionByName(joined.mapInArrow(judge, schema))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns."""
    # the input's columns stay together in one, so that no name of theirs meets one of ours
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))
    return _judged(plain, docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")), True, docs.schema)


def quality_measures(docs: DataFrame) -> DataFrame:
    """One row for each document: measures, distances and verdict."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), F.col("lang").cast("string").alias("_lang"))
    return _judged(plain, docs, False, VERDICT)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(read_table(spark, sf_dir, "documents"))
