"""Quality classifier: an interpolated modified Kneser-Ney n-gram model.

Tokens are the UTF-8 bytes of a text, so one model serves every language and
script, an n-gram of up to 7 tokens is one exact 64-bit key, and a batch of
documents holds few distinct n-grams. A document is padded with N - 1 start
marks and one end mark (bytes that UTF-8 never uses).

1. Batches: documents are packed, compressed, into rows of about
   ``batch_bytes`` of text of one fold; trusted ones are dealt by fold first,
   so that a batch is full. Each row also lists its distinct n-grams.
2. Counting: the n-grams of trusted documents are counted per batch and
   summed by key and fold. Trusted texts fall into ``HELD`` folds by a hash of
   the text, so copies share a fold. Model 0 takes all folds, model f all but
   fold f. Lower orders use continuation counts, every order its own three
   discounts.
3. Sharded count joins: the distinct n-grams of every batch go, packed, to
   the shard of their key and meet the model's entries there; the answers
   come back per batch. What is sent grows with the corpus, never a model
   with the whole corpus in one place.
4. Scoring: a batch turns its answers into one log-probability per distinct
   n-gram by the interpolation p_k = alpha_k + gamma_k p_(k-1) and sums them
   over its documents. Trusted documents are scored by model 0 and by the
   model that has not seen their fold, in one job.
5. Thresholds: per language, the quantiles of the log-perplexity of all
   trusted documents, each by the model that has not seen it, read off an
   exact count in steps of 1/``STEPS``. A short text says little about itself:
   before the comparison each log-perplexity is joined by ``PRIOR`` tokens of
   its language's mean.

Defined results: a null text has a null perplexity and is rejected; an empty
text is the end mark alone and scored like any other. Null languages are one
language. A language without trusted documents takes the bounds of all of
them; without any, nothing is rejected but null texts. A fold that holds all
trusted text has an empty model. Rows that repeat are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelab.llm.shared import bucketed, discard, join_keys, noted, written

ORDER, BATCH_BYTES, CHUNK = 5, 16 << 20, 4 << 20
START, END = 0xFF, 0xFE
STEPS, HELD, PRIOR = 1024, 8, 64
VOCABULARY = 257        # 256 byte values less the start mark, plus the end mark and one for the unknown


def _stream(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The padded bytes of texts and the number of the text of each byte."""
    parts = [b"\xff" * (order - 1) + (t or "").encode() + b"\xfe" for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _grams(b: np.ndarray, order: int) -> np.ndarray:
    """Keys of the n-grams that end at each byte from ``order - 1`` on."""
    k = np.zeros(len(b) - order + 1, np.int64)
    for j in range(order):
        k <<= 8
        k |= b[j:len(b) - order + 1 + j]
    return k


def ngrams(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text numbers) of every predicted token with its full history."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b, doc = _stream(texts, order)
    keys, ends = _grams(b, order), slice(order - 1, None)
    predicted = b[ends] != START
    return keys[predicted], doc[ends][predicted]


def _chunks(texts: list, size: int = CHUNK):
    """Runs of texts of about ``size`` characters, with their first number."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 8
        if held >= size:
            yield lo, texts[lo:i + 1]
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def _tag(keys: np.ndarray, order: int) -> np.ndarray:
    return keys | np.int64(order << 56)


def _suffixes(top: np.ndarray, order: int) -> list[np.ndarray]:
    """Distinct keys by order, 1 to ``order``, of distinct keys of the highest."""
    out = [top]
    for k in range(order - 1, 0, -1):
        out.append(np.unique(out[-1] & np.int64((1 << 8 * k) - 1)))
    return out[::-1]


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed differences."""
    d = np.diff(keys, prepend=np.int64(0))
    return zstandard.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), 3) if len(d) else b""


def _unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64)[:, 0])


def _sealed(tables: list) -> bytes:
    """Rows of documents, compressed."""
    table = pa.Table.from_batches(tables)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.compress(sink.getvalue().to_pybytes(), 9)


def _opened(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(raw)).read_all()


def _gathered(parts, size: int):
    """(fold, record batches) of about ``size`` characters from (fold, record
    batch) in any order; what is left of each fold at the end."""
    held, sizes = {}, {}
    for fold, b in parts:
        for lo, some in _chunks(b.column("text").to_pylist(), size):
            held.setdefault(fold, []).append(b.slice(lo, len(some)))
            sizes[fold] = sizes.get(fold, 0) + sum(len(t or "") + 8 for t in some)
            if sizes[fold] >= size:
                sizes.pop(fold)
                yield fold, held.pop(fold)
    for fold in sorted(held):
        yield fold, held[fold]


def _by_fold(batches):
    for b in batches:
        folds = b.column("fold").to_numpy()
        for fold in np.unique(folds).tolist():
            yield fold, b.filter(pa.array(folds == fold))


def _bundles(batches):
    """Rows (bundle, fold, docs): each task's documents of a fold, compressed,
    on their way to a batch of their fold."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    for n, (fold, tables) in enumerate(_gathered(_by_fold(batches), CHUNK)):
        yield pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([fold]), pa.array([_sealed(tables)], pa.binary())], ["bundle", "fold", "docs"])


def _unbundled(batches):
    for b in batches:
        for fold, raw in zip(b.column("fold").to_pylist(), b.column("docs").to_pylist()):
            for part in _opened(raw).to_batches():
                yield fold, part


def _batches_of(order: int, batch_bytes: int, bundled: bool):
    """Rows (batch, fold, docs, top, learnt, counts): compressed documents of
    one fold (0: not trusted), their distinct n-grams, and those of the
    documents that teach, with counts."""
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for number, (fold, tables) in enumerate(_gathered(_unbundled(batches) if bundled else _by_fold(batches), batch_bytes)):
            texts = [t for b in tables for t in b.column("text").to_pylist()]
            every, keys, counts = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
            for _, some in _chunks(texts):
                # a null text is scored like an empty one but teaches nothing
                for group, teaches in (([t for t in some if t is not None], fold > 0), ([t for t in some if t is None], False)):
                    k = np.sort(ngrams(group, order)[0])
                    first = np.flatnonzero(np.diff(k, prepend=-1))
                    every.append(k[first])
                    if teaches:
                        n = np.diff(first, append=len(k))
                        u, inv = np.unique(np.concatenate([keys, k[first]]), return_inverse=True)
                        counts = np.bincount(inv, np.concatenate([counts, n]), len(u)).astype(np.int64)
                        keys = u
            top = np.unique(np.concatenate(every))
            yield pa.RecordBatch.from_pylist([{
                "batch": part << 32 | number << 1 | bundled, "fold": fold, "docs": _sealed(tables), "top": _pack_keys(top),
                "learnt": _pack_keys(keys), "counts": zstandard.compress(counts.tobytes(), 3)}], schema=_BATCH)
    return run


_BATCH = pa.schema([("batch", pa.int64()), ("fold", pa.int64()), ("docs", pa.binary()), ("top", pa.binary()), ("learnt", pa.binary()), ("counts", pa.binary())])


def _learnt(batches):
    for b in batches:
        for fold, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
            own = _unpack_keys(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), fold)), pa.array(own), pa.array(np.frombuffer(zstandard.decompress(counts), np.int64))],
                                             ["fold", "key", "n"])


def leave_one_out(counts: DataFrame, folds: int) -> DataFrame:
    """``counts(fold, key, n)``, folds from 1, to (key, n0, n1, ...): model 0
    counts all folds, model f all but fold f."""
    by = counts.groupBy("key").agg(F.sum("n").alias("n0"), *(F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(1, folds + 1)))
    return by.select("key", "n0", *((F.col("n0") - F.col(f"n{f}")).alias(f"n{f}") for f in range(1, folds + 1)))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts for counts of one, two, and three or
    more; a half, one and one and a half where the counts of counts give none."""
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        if all(0 < x < c for x, c in zip(d, (1, 2, 3))):
            return d
    return 0.5, 1.0, 1.5


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """``counts(key, n0, n1, ...)`` of the highest order, one count a model, to
    the models' entries (key, history, share), key tagged with its order and
    share one value a model: the discounted share of an n-gram after its
    history, or (``history``) the weight that a history leaves to the next
    lower order. What a model lacks has the values of an unknown key, 0 and 1."""
    level, entries, models = counts, None, range(len(counts.columns) - 1)
    for k in range(order, 0, -1):
        if k < order:       # distinct one-token extensions to the left
            level = level.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key")).agg(*(F.count_if(F.col(f"n{m}") > 0).alias(f"n{m}") for m in models))
        level = written(level)
        found = level.agg(*(F.count_if(F.col(f"n{m}") == c) for m in models for c in (1, 2, 3, 4))).first()
        discount = []
        for m in models:
            n, (d1, d2, d3) = F.col(f"n{m}"), discounts(*(x or 0 for x in found[4 * m:4 * m + 4]))
            discount.append(F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3))
        history = F.shiftright("key", 8)
        totals = level.groupBy(history.alias("history")).agg(*(F.sum(f"n{m}").alias(f"total{m}") for m in models), *(F.sum(discount[m]).alias(f"left{m}") for m in models))
        share = lambda over, m, none: F.when(F.col(f"total{m}") > 0, over / F.col(f"total{m}")).otherwise(none).cast("float")
        alpha = level.withColumn("history", history).join(totals, "history").select(
            F.col("key").bitwiseOR(F.lit(k << 56)).alias("key"), F.lit(False).alias("history"), F.array(*(share(F.col(f"n{m}") - discount[m], m, 0.0) for m in models)).alias("share"))
        gamma = totals.select(F.col("history").bitwiseOR(F.lit((k - 1) << 56)).alias("key"), F.lit(True).alias("history"),
                              F.array(*(share(F.col(f"left{m}"), m, 1.0) for m in models)).alias("share"))
        both = alpha.union(gamma)
        entries = both if entries is None else entries.union(both)
    return entries


def _asked(top: np.ndarray, order: int) -> np.ndarray:
    """The tagged keys a batch needs, ascending: its n-grams of every order
    and the histories of the next."""
    by_order = [np.zeros(1, np.int64), *_suffixes(top, order)]
    own = [np.unique(np.concatenate([x, by_order[k + 1] >> 8])) if k < order else x for k, x in enumerate(by_order)]
    return np.concatenate([_tag(x, k) for k, x in enumerate(own)])


def _models(fold: int, seen: bool) -> list[int]:
    """The models that score a fold: its own, and with ``seen`` that of all."""
    return sorted({fold, 0}) if seen else [fold]


def _questions(order: int, shards: int):
    def run(batches):
        for b in batches:
            for batch, fold, top in zip(*(c.to_pylist() for c in b.columns)):
                keys = _asked(_unpack_keys(top), order)
                shard = keys % shards
                by = np.argsort(shard, kind="stable")       # keys stay ascending within a shard
                names, at = np.unique(shard[by], return_index=True)
                rows = [(s, batch, fold, _pack_keys(k)) for s, k in zip(names.tolist(), np.split(keys[by], at[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                                 ["shard", "batch", "fold", "keys"])
    return run


def _answers(seen: bool):
    """One shard: each batch's keys with alpha and gamma (0 and 1 if unknown)
    of each model that scores the batch."""
    def run(key, asked, entries):
        sides = []
        for history, unknown in ((False, 0.0), (True, 1.0)):
            own = entries.filter(pc.equal(entries.column("history"), history))
            known = own.column("key").to_numpy()
            by = np.argsort(known)
            share = pc.list_flatten(own.column("share")).to_numpy().reshape(len(known), -1 if len(known) else 1)
            sides.append((known[by], share[by], unknown))
        out = []
        for batch, fold, raw in zip(*(asked.column(c).to_pylist() for c in ("batch", "fold", "keys"))):
            keys, values = _unpack_keys(raw), []
            for m in _models(fold, seen):
                for known, share, unknown in sides:
                    if len(known):
                        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                        values.append(np.where(known[at] == keys, share[at, m], np.float32(unknown)))
                    else:
                        values.append(np.full(len(keys), unknown, np.float32))
            out.append((batch, key[0].as_py(), raw, zstandard.compress(np.concatenate(values).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                    names=["batch", "shard", "keys", "values"])
    return run


def _lookup(order: int, models: list[int], answers: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(keys of the highest order, log-probabilities) by model from a batch's answers."""
    keys = [_unpack_keys(a["keys"]) for a in answers]
    values = [np.ascontiguousarray(np.frombuffer(zstandard.decompress(a["values"]), np.uint8).reshape(4, -1).T).view(np.float32).reshape(2 * len(models), len(k))
              for a, k in zip(answers, keys)]
    keys, values = np.concatenate(keys), np.concatenate(values, axis=1)
    by = np.argsort(keys)
    return {m: _interpolated(order, keys[by], values[2 * i][by].astype(float), values[2 * i + 1][by].astype(float)) for i, m in enumerate(models)}


def _interpolated(order: int, keys: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.searchsorted(keys, [k << 56 for k in range(order + 2)])
    body = (1 << 56) - 1
    below_keys, below = np.zeros(1, np.int64), np.full(1, 1 / VOCABULARY)      # order 0
    for k in range(1, order + 1):
        own = keys[cut[k]:cut[k + 1]] & body
        history = own >> 8
        at = np.searchsorted(keys, _tag(history, k - 1))
        at = np.minimum(at, len(keys) - 1)
        weight = np.where(keys[at] == _tag(history, k - 1), gamma[at], 1.0)
        lower = below[np.searchsorted(below_keys, own & ((1 << 8 * (k - 1)) - 1))]
        below = alpha[cut[k]:cut[k + 1]] + weight * lower
        below_keys = own
    return below_keys, np.log(below)


def _scored(order: int, seen: bool):
    def run(batches):
        for b in batches:
            for fold, docs, answers in zip(*(c.to_pylist() for c in b.columns)):
                table = _opened(docs)
                texts = table.column("text").to_pylist()
                models = _lookup(order, _models(fold, seen), answers)
                total, tokens = {m: np.zeros(len(texts)) for m in models}, np.zeros(len(texts))
                for lo, some in _chunks(texts):
                    keys, doc = ngrams(some, order)
                    for m, (known, logp) in models.items():
                        total[m][lo:lo + len(some)] = np.bincount(doc, logp[np.searchsorted(known, keys)], len(some))
                    tokens[lo:lo + len(some)] = np.bincount(doc, minlength=len(some))
                entropy, unseen = (pa.array([None if t is None or m not in total else float(x) for t, x in zip(texts, -total.get(m, tokens) / tokens)], pa.float64())
                                   for m in (0, fold or -1))
                yield from pa.Table.from_arrays([table.column("doc_id"), table.column("lang"), pa.array([fold > 0] * len(texts)), entropy, unseen, pa.array(tokens.astype(np.int64))],
                                                names=["doc_id", "lang", "teaches", "entropy", "unseen", "tokens"]).to_batches()
    return run


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER, batch_bytes: int = BATCH_BYTES, shards: int | None = None,
                 seen: bool = True) -> DataFrame:
    """``docs(doc_id, text, lang)`` scored by a model of the documents whose
    id is in ``trusted(doc_id)``: doc_id, lang, teaches (whether it is one of
    them), entropy (log-perplexity a token, in nats), unseen (of those that
    teach, the same by the model without their fold) and tokens. Without
    ``seen``, entropy is null for those that teach. One row per input row;
    written."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    flags = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    fold = F.when(F.col("trusted"), F.pmod(F.xxhash64(F.lit(HELD), "text"), F.lit(HELD)) + 1).otherwise(0)
    rows = join_keys(rows, flags, "doc_id", "left").select("doc_id", "text", "lang", fold.cast("long").alias("fold"), F.col("trusted").isNotNull().alias("teaches"))
    with noted() as made:
        # trusted texts meet those of their fold, compressed, so that batches are full whatever a task holds of a fold
        good = rows.where("fold > 0")
        salts = max(1, -(-(good.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (HELD * batch_bytes)))
        bundles = (good.mapInArrow(_bundles, "bundle long, fold long, docs binary")
                   .repartition(HELD * salts, "fold", F.pmod(F.xxhash64("bundle"), F.lit(salts))).select("fold", "docs"))
        fields = "batch long, fold long, docs binary, top binary, learnt binary, counts binary"
        packed = bucketed(bundles.mapInArrow(_batches_of(order, batch_bytes, True), fields)
                          .union(rows.where("fold = 0").mapInArrow(_batches_of(order, batch_bytes, False), fields)), "batch")
        learnt = packed.where("fold > 0").select("fold", "learnt", "counts").mapInArrow(_learnt, "fold long, key long, n long")
        with noted() as levels:
            entries = kneser_ney(leave_one_out(learnt, HELD), order)
        model = written(entries)
        discard(spark, levels)
        if shards is None:
            # a shard holds about a million entries, one value a model, and the questions of about 16 batches
            shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), model.count() >> 20, packed.count() // 16) | 1
        asked = packed.select("batch", "fold", "top").mapInArrow(_questions(order, shards), "shard long, batch long, fold long, keys binary")
        sharded = model.withColumn("shard", F.pmod("key", F.lit(shards)))
        answers = asked.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(_answers(seen), "batch long, shard long, keys binary, values binary")
        per_batch = answers.groupBy("batch").agg(F.collect_list(F.struct("keys", "values")).alias("answers"))
    scored = written(packed.select("batch", "fold", "docs").join(per_batch, "batch").select("fold", "docs", "answers")
                     .mapInArrow(_scored(order, seen), "doc_id long, lang string, teaches boolean, entropy double, unseen double, tokens long"))
    discard(spark, made)
    return scored


def _language(lang: str = "lang"):
    return F.coalesce(F.concat(F.lit("+"), lang), F.lit("-"))


def _by_language(scores: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``scores(key, ...)`` with columns of ``table(key, ...)``: those of the
    row's language, else those of the row with a null key."""
    other = table.where("key is null").agg(*(F.max(c).alias(f"{c}_all") for c in columns))
    own = written(table.where("key is not null"))
    both = join_keys(scores, own, "key", "left", 100_000).crossJoin(F.broadcast(other))
    return both.withColumns({c: F.coalesce(c, f"{c}_all") for c in columns}).drop(*(f"{c}_all" for c in columns))


def means(scores: DataFrame) -> DataFrame:
    """Mean log-perplexity of unseen trusted documents by language key, and of
    all of them in the row with a null key (sums of whole steps: exact)."""
    step = F.floor(F.col("unseen") * STEPS)
    by = scores.where("unseen is not null").groupBy("key").agg(F.sum(step).alias("s"), F.count("*").alias("n"))
    both = by.union(by.agg(F.lit(None).cast("string"), F.sum("s"), F.sum("n")))
    return both.select("key", (F.col("s") / F.col("n") / STEPS).alias("mean"))


def thresholds(scores: DataFrame, low: float, high: float) -> DataFrame:
    """The ``low`` and ``high`` quantiles of the unseen trusted documents'
    ``level`` by language key, and of all of them in the row with a null key:
    the steps of 1/STEPS at which the cumulative count passes the share."""
    steps = scores.where("teaches and level is not null").groupBy("key", F.floor(F.col("level") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    both = steps.union(steps.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("key"), "step", "n"))
    by = Window.partitionBy("key")
    run = both.withColumn("upto", F.sum("n").over(by.orderBy("step"))).withColumn("total", F.sum("n").over(by))
    return run.groupBy("key").agg(
        F.min(F.when(F.col("upto") > F.col("total") * low, F.col("step") / STEPS)).alias("lo"),
        F.min(F.when(F.col("upto") >= F.col("total") * high, (F.col("step") + 1) / STEPS)).alias("hi"))


def classify(docs: DataFrame, trusted: DataFrame, low: float | None = None, high: float = 0.99, **how) -> DataFrame:
    """One row per document: doc_id, lang, tokens, perplexity (a token), level
    (log-perplexity with the language's prior), lower and upper (the bounds of
    its language's levels) and kept. A trusted document goes by the model that
    has not seen it. Without ``low`` there is no lower bound, so copies of
    trusted text are not rejected."""
    scores = perplexities(docs, trusted, seen=False, **how).withColumn("entropy", F.coalesce("unseen", "entropy")).withColumn("key", _language())
    scores = _by_language(scores, means(scores), ["mean"])
    level = (F.col("entropy") * F.col("tokens") + F.lit(PRIOR) * F.coalesce("mean", "entropy")) / (F.col("tokens") + PRIOR)
    scores = scores.withColumn("level", level)
    bounds = thresholds(scores, low or 0.0, high)
    if low is None:
        bounds = bounds.withColumn("lo", F.when(F.col("lo").isNotNull(), F.lit(0.0)))
    scores = _by_language(scores, bounds, ["lo", "hi"])
    inside = F.coalesce((F.col("level") >= F.col("lo")) & (F.col("level") < F.col("hi")), F.col("lo").isNull())
    return scores.select("doc_id", "lang", "tokens", F.exp("entropy").alias("perplexity"), "level", F.col("lo").alias("lower"), F.col("hi").alias("upper"),
                         (F.col("entropy").isNotNull() & inside).alias("kept"))
