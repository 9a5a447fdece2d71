"""Quality classifier: interpolated modified Kneser-Ney byte n-grams trained on trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, bundle, chunks, materialize, pack, shuffle_partitions, signature, squeeze, unbundle, unpack, unsqueeze

#: Bytes of an n-gram; a byte that UTF-8 never has marks what lies before a text.
ORDER, BEFORE = 5, 0xFF
BITS = 8 * ORDER
#: An odd factor that spreads n-grams over the shards, and its inverse modulo 2^BITS; products stay below 2^63.
SPREAD = 0x2545F5
UNSPREAD = pow(SPREAD, -1, 1 << BITS)
#: A chunk of documents ends at so many bytes of text; its distinct n-grams are looked up once.
CHUNK_BYTES = 12 << 20
#: Of the trusted documents, one in so many sets thresholds rather than counts.
HELD_OUT = 5
#: A document is rejected above this quantile of the held-out trusted documents of its language, times the margin.
QUANTILE, MARGIN = 0.99, 1.02
#: Bytes at the language's mean that every document is taken to have besides its own: short texts say little.
PRIOR_BYTES = 100
#: Labels beyond this many rows are joined by a shuffle rather than sent to all executors (24 bytes a row).
BROADCAST_ROWS = 2_000_000


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each byte of the texts, as integers, and how many each text has (one a byte)."""
    mark = bytes([BEFORE]) * (ORDER - 1)
    raw = np.frombuffer(b"".join(mark + (t or b"") for t in texts), dtype=np.uint8)
    counts = np.array([len(t or b"") for t in texts], dtype=np.int64)
    if not counts.sum():
        return np.zeros(0, dtype=np.uint64), counts
    codes = np.zeros(len(raw) - ORDER + 1, dtype=np.uint64)
    for i in range(ORDER):
        codes <<= np.uint64(8)
        codes |= raw[i : len(raw) - ORDER + 1 + i]
    return codes[raw[ORDER - 1 :] != BEFORE], counts


def spread(codes: np.ndarray) -> np.ndarray:
    return codes * np.uint64(SPREAD) & np.uint64((1 << BITS) - 1)


def slices(texts: list[bytes | None], limit: int = 1 << 20) -> Iterator[list[bytes | None]]:
    """The texts in runs of about ``limit`` bytes: their n-grams take sixteen times that and more."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield texts[begin : i + 1]
            begin, size = i + 1, 0
    yield texts[begin:]


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(code, n)`` of all n-grams of the texts; every task sums its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(codes.astype(np.int64)), pa.array(sums)], names=["code", "n"])

        for texts in (part for batch in batches for part in slices(batch.column(0).to_pylist())):
            found, n = np.unique(grams(texts)[0], return_counts=True)
            merged, at = np.unique(np.concatenate([codes, found]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([sums, n]), minlength=len(merged)).astype(np.int64)
            codes, sums = merged, total
            if len(codes) > 2_000_000:
                yield out()
                codes, sums = codes[:0], sums[:0]
        yield out()

    counted = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "code bigint, n bigint")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


class Model:
    """Tables ``grams(k, code, a)`` and ``contexts(k, context, g)`` of the model, for n-grams of k = 1 to ORDER bytes.

    p(w | h) = a(hw) + g(h) p(w | h without its first byte), down to the uniform distribution over 256 bytes; a is
    the discounted share of hw among all that follows h, g is what the discounts of h leave. Below the highest
    order counts are those of different bytes to the left; at the start of a text, where there is one, the count
    itself. Discounts for counts of one, two and more are estimated from each order's counts of counts.
    """

    def __init__(self, docs: DataFrame):
        top = materialize(gram_counts(docs).select(F.lit(ORDER).alias("k"), "code", "n"), "grams")
        levels = [top]
        for k in range(ORDER - 1, 0, -1):
            size = 8 * k
            code = F.col("code").bitwiseAND(F.lit((1 << size) - 1))
            starts = F.shiftright(code, size - 8) == BEFORE
            lower = levels[-1].groupBy(code.alias("code")).agg(F.sum(F.when(starts, F.col("n")).otherwise(F.lit(1))).alias("n"))
            levels.append(materialize(lower.select(F.lit(k).alias("k"), "code", "n"), "grams"))
        counts = levels[0]
        for level in levels[1:]:
            counts = counts.unionByName(level)
        seen = counts.groupBy("k").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).collect()  # ORDER rows
        rates = []
        for r in seen:
            y = r.n1 / (r.n1 + 2 * r.n2) if r.n1 + r.n2 else 0.5
            d = [i - (i + 1) * y * r[f"n{i + 1}"] / r[f"n{i}"] if r[f"n{i}"] else 0.5 * i for i in (1, 2, 3)]
            rates.append((r.k, *[float(min(max(x, 0.05), i - 0.05)) for i, x in enumerate(d, 1)]))
        cost = F.lit(0.0)
        for k, d1, d2, d3 in rates:
            cost = F.when(F.col("k") == k, F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).otherwise(cost)
        counts = counts.select("k", "code", "n", cost.alias("d"), F.shiftright("code", 8).alias("context"))
        total = counts.groupBy("k", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("lost"))
        total = materialize(total, "contexts")
        shares = counts.join(total, ["k", "context"]).select("k", "code", ((F.col("n") - F.col("d")) / F.col("total")).alias("a"))
        self.grams = materialize(shares, "shares")
        self.contexts = total.select("k", "context", (F.col("lost") / F.col("total")).alias("g"))

    def log_probabilities(self, codes: DataFrame) -> DataFrame:
        """``(code, p)``: the natural logarithm of each given n-gram's last byte after the others; ``codes`` are distinct."""
        wanted = {ORDER: codes.select("code")}
        for k in range(ORDER - 1, 0, -1):
            wanted[k] = wanted[k + 1].select(F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).distinct()
        lower = None
        for k in range(1, ORDER + 1):
            own = self.grams.where(F.col("k") == k).select("code", "a")
            left = self.contexts.where(F.col("k") == k).select(F.col("context").alias("c"), "g")
            rows = wanted[k].join(own, "code", "left").withColumn("c", F.shiftright("code", 8)).join(left, "c", "left")
            if lower is None:
                rows = rows.withColumn("q", F.lit(1 / 256))
            else:
                rows = rows.withColumn("s", F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
                rows = rows.join(lower.select(F.col("code").alias("s"), F.col("p").alias("q")), "s")
            rows = rows.select("code", (F.coalesce("a", F.lit(0.0)) + F.coalesce("g", F.lit(1.0)) * F.col("q")).alias("p"))
            lower = rows if k in (1, ORDER) else materialize(rows, "probabilities")
        return lower.select("code", F.log("p").alias("p"))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``_nats``, the text's negative log probability, and ``_bytes``.

    Every chunk of documents asks shards of n-grams for its distinct ones; a shard passes each once to the joins
    with the count tables and answers the chunks, which sum over their documents. A very common n-gram is asked
    for once a chunk. The input is read twice and must come in the same order, as tables do.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shards = shuffle_partitions(spark)
    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.select(*[F.col(f"`{c}`").cast("string" if c == text_col else t).alias(f"c{i}") for i, (c, t) in enumerate(docs.dtypes)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in chunks(batches, at, CHUNK_BYTES):
            texts = table.column(at).cast(pa.binary()).to_pylist()
            distinct = np.unique(np.concatenate([np.unique(spread(grams(part)[0])) for part in slices(texts)]))
            shard = (distinct * np.uint64(shards)) >> np.uint64(BITS)
            ends = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            mark = signature(texts)
            for s in range(shards):
                if ends[s] < ends[s + 1]:
                    payload = pack((mark, squeeze(distinct[ends[s] : ends[s + 1]])), level=1)
                    columns = [pa.array([chunk], pa.int64()), pa.array([s], pa.int64()), pa.array([payload], pa.binary())]
                    yield pa.record_batch(columns, names=["chunk", "shard", "payload"])

    def distinct_codes(asked: pd.DataFrame) -> pd.DataFrame:
        codes = np.unique(np.concatenate([unsqueeze(unpack(p)[1]) for p in asked["payload"]]))
        with np.errstate(over="ignore"):
            return pd.DataFrame({"code": (codes * np.uint64(UNSPREAD) & np.uint64((1 << BITS) - 1)).astype(np.int64)})

    def answer(key: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        codes = spread(known["code"].to_numpy(np.int64).astype(np.uint64))
        order = np.argsort(codes)
        codes, values = codes[order], known["p"].to_numpy(np.float32)[order]
        replies = []
        for payload in asked["payload"]:
            mark, own = unpack(payload)
            replies.append(pack((mark, own, values[np.searchsorted(codes, unsqueeze(own))]), level=1))
        return pd.DataFrame({"chunk": asked["chunk"], "shard": asked["shard"], "reply": replies})

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in chunks(batches, at, CHUNK_BYTES):
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([bundle(table)], pa.binary())], names=["chunk", "rows"])

    def total(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        answers = [unpack(r) for _, r in sorted(zip(replies.column("shard").to_pylist(), replies.column("reply").to_pylist()))]
        codes = np.concatenate([unsqueeze(own) for _, own, _ in answers]) if answers else np.zeros(0, dtype=np.uint64)
        values = np.concatenate([v for *_, v in answers]) if answers else np.zeros(0, dtype=np.float32)
        for blob in rows.column("rows").to_pylist():
            table = unbundle(blob)
            texts = table.column(at).cast(pa.binary()).to_pylist()
            mark = signature(texts)
            if any(m != mark for m, *_ in answers):
                raise RuntimeError("the input came in another order when read again: write it to a table first")
            nats, sizes = [], []
            for begin in range(0, len(texts), 256):
                found, counts = grams(texts[begin : begin + 256])
                p = values[np.searchsorted(codes, spread(found))].astype(np.float64)
                sums = np.concatenate([[0.0], np.cumsum(p)])
                ends = np.cumsum(counts)
                nats.append(sums[ends - counts] - sums[ends])
                sizes.append(counts)
            table = table.append_column("_nats", pa.array(np.concatenate(nats)))
            out.append(table.append_column("_bytes", pa.array(np.concatenate(sizes))))
        return pa.concat_tables(out)

    asked = materialize(plain.mapInArrow(ask, "chunk bigint, shard bigint, payload binary"), "asked")
    wanted = asked.groupBy("shard").applyInPandas(distinct_codes, "code bigint")
    known = model.log_probabilities(materialize(wanted, "wanted"))
    mixed = (F.col("code") * F.lit(SPREAD)).bitwiseAND(F.lit((1 << BITS) - 1))
    known = known.withColumn("shard", F.shiftright(mixed * F.lit(shards), BITS).cast("bigint"))
    replies = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(answer, "chunk bigint, shard bigint, reply binary")
    fields = ", ".join(f"c{i} {t if i != at else 'string'}" for i, (_, t) in enumerate(docs.dtypes))
    rows = plain.mapInArrow(bundled, "chunk bigint, rows binary")
    scored = rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(total, f"{fields}, _nats double, _bytes bigint")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "_nats", "_bytes")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """All rows and columns of ``docs`` with ``_perplexity`` (per byte), ``_score`` and ``_keep``; columns of these names are replaced.

    Trusted are the documents that ``labels(doc_id, quality, toxic)`` give quality 1 and not toxic 1. Four in five
    of them, by a hash of the text, train the model; all of their text counts. The rest is scored like any
    document and sets each language's threshold: ``margin`` times the ``quantile`` of its scores. A score is the
    bytes' mean negative log probability, taken with PRIOR_BYTES more at the mean of the language. Languages
    without trusted documents, null among them, have the threshold of all languages together.

    Null and empty texts have no perplexity; they have the mean as their score and are kept. Very long texts count
    whole, as a chunk of their own. Repeated rows get equal results; an empty table gives an empty table; without any
    trusted document all are kept. Further columns may have any name.
    """
    added = ("_perplexity", "_score", "_keep")
    inner = {n: n if n in ("doc_id", "text", "lang") else f"extra{i}" for i, n in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{n}`").alias(own) for n, own in inner.items()])
    found = _classified(plain, labels, quantile, margin)
    return found.select(*[F.col(own).alias(n) for n, own in inner.items() if n not in added], *added)


def _classified(docs: DataFrame, labels: DataFrame, quantile: float, margin: float) -> DataFrame:
    """``classify`` for columns whose names don't begin with an underscore."""
    bounded_batches(docs.sparkSession)
    trusted = labels.where((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))).select(F.col("doc_id").cast("bigint").alias("_trusted")).distinct()
    if labels.count() <= BROADCAST_ROWS:
        trusted = F.broadcast(trusted)
    basis = docs.select(F.col("doc_id").alias("_id"), "text", F.coalesce("lang", F.lit("")).alias("_lang"))
    basis = basis.join(trusted, F.col("_id") == F.col("_trusted"), "left_semi").where(F.length("text") > 0)
    fold = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT))
    held = materialize(basis.where(fold == 0).select("text", "_lang"), "held-out")
    train = basis.where(fold != 0).select("text")
    if held.isEmpty():  # so few that they have to serve for both
        held = materialize(basis.select("text", "_lang"), "held-out")
        train = basis.select("text")
    if held.isEmpty():
        return docs.select("*", F.lit(None).cast("double").alias("_perplexity"), F.lit(0.0).alias("_score"), F.lit(True).alias("_keep"))
    model = Model(train)
    checked = materialize(score(held, model).select("_lang", "_nats", "_bytes"), "held-out-scores")
    limits = _limits(checked, quantile, margin)
    every = limits.where("_lang is null").drop("_lang").select(F.col("_mean").alias("_mean0"), F.col("_limit").alias("_limit0"))
    own = limits.where("_lang is not null")
    scored = score(docs, model).withColumn("_l", F.coalesce("lang", F.lit("")))
    if own.count() <= 10_000:  # languages
        own = F.broadcast(own)
    scored = scored.join(own, F.col("_l") == F.col("_lang"), "left").join(F.broadcast(every))
    mean = F.coalesce("_mean", "_mean0")
    value = (F.col("_nats") + mean * PRIOR_BYTES) / (F.col("_bytes") + PRIOR_BYTES)
    perplexity = F.when(F.col("_bytes") > 0, F.exp(F.col("_nats") / F.col("_bytes")))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], perplexity.alias("_perplexity"), value.alias("_score"), (value <= F.coalesce("_limit", "_limit0")).alias("_keep"))


def _limits(checked: DataFrame, quantile: float, margin: float) -> DataFrame:
    """``(_lang, _mean, _limit)`` a language, and a row with a null language for all."""
    both = checked.unionByName(checked.withColumn("_lang", F.lit(None).cast("string")))
    means = both.groupBy("_lang").agg((F.sum("_nats") / F.sum("_bytes")).alias("_mean"))
    both = both.alias("b").join(means.alias("m"), F.col("b._lang").eqNullSafe(F.col("m._lang")))
    value = (F.col("_nats") + F.col("_mean") * PRIOR_BYTES) / (F.col("_bytes") + PRIOR_BYTES)
    limits = both.groupBy("b._lang").agg(F.first("_mean").alias("_mean"), (F.percentile_approx(value, quantile, 10_000) * margin).alias("_limit"))
    return materialize(limits, "limits")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns as they are, whatever further ones are called."""
    inner = {n: n if n in ("doc_id", "text", "lang") else f"extra{i}" for i, n in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{n}`").alias(own) for n, own in inner.items()])
    return _classified(plain, labels, QUANTILE, MARGIN).where("_keep").select(*[F.col(own).alias(n) for n, own in inner.items()])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "lang", F.col("_perplexity").alias("perplexity"), F.col("_score").alias("score"), F.col("_keep").alias("keep"))
