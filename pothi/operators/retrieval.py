"""Lexical and dense retrieval for many queries at once, fusion and diversification.

Texts, queries and vectors are tables; one plan serves all queries. Ties go by
document id. Scores are rounded to six places where they are ranked, since the
order of summation differs from run to run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pothi.functions.lexical import term_list, trimmed, with_terms, words
from pothi.plans.lineage import cut

K1, B = 1.5, 0.75
# Score added by intent and tier, bonuses of primary authors, duplicate threshold.
TIER_WEIGHTS = {"doctrinal": (0.10, 0.04, -0.12), "narrative": (0.05, 0.08, -0.08), "navigational": (0.0, 0.0, 0.08), "unknown": (0.02, 0.02, -0.08)}
PRIMARY_BONUS, FUSED_BONUS, DUPLICATE, RRF_K = 0.04, 0.003, 0.92, 60
MOST_TERMS = 200_000


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term: one row per occurrence."""
    raw = df.where(F.col(text).isNotNull()).select(key, F.explode(words(F.col(text))).alias("raw"))
    return with_terms(raw.select(key, trimmed(F.col("raw")).alias("tok")).where("tok <> ''"), "tok")


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf."""
    return terms(df, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))


_ROW = "\u0001"


def hits(df: DataFrame, key: str, text: str, asked: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """key, term, tf, dl of every text: one row per term of asked(term) it has, and one with a null term.

    Texts are taken apart once and stay where they are; what is exchanged are the
    counts of asked terms and one count of all others. A text whose key occurs
    twice counts once (the text of the least hash), a null text has no terms. The asked terms go to all
    tasks while there are at most ``most_terms``, beyond by a shuffle.
    """
    few = asked.limit(most_terms + 1).count() <= most_terms
    some = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.xxhash64(some).alias("h"), F.explode(F.concat(F.array(F.lit(_ROW)), words(some))).alias("raw"))
    occurs = with_terms(rows.select("key", "h", F.when(F.col("raw") == _ROW, F.lit(_ROW + _ROW)).otherwise(trimmed(F.col("raw"))).alias("tok")), "tok")
    wanted = asked.select(F.col("term").alias("asked")).distinct()
    marked = occurs.join(F.broadcast(wanted) if few else wanted, F.col("term") == F.col("asked"), "left")
    counted = marked.groupBy("key", "h", F.when(F.col("term") == _ROW + _ROW, F.lit(_ROW)).otherwise(F.col("asked")).alias("term")).agg(F.count("*").alias("n"))
    # Repeated rows: a row's mark counts its copies.
    per = counted.groupBy("key", "h").agg(F.sum(F.when(F.col("term") == _ROW, F.col("n"))).alias("copies"), F.sum(F.when(F.col("term") == _ROW, 0).otherwise(F.col("n"))).alias("all"), F.collect_list(F.when(F.col("term") != _ROW, F.struct("term", "n"))).alias("found"))
    one = per.groupBy("key").agg(F.min_by(F.struct("copies", "all", "found"), "h").alias("r"))
    blank = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n")))
    each = one.select("key", "r.copies", "r.all", F.explode(F.concat(F.col("r.found"), blank)).alias("f"))
    return each.select(F.col("key").alias(key), "f.term", F.floor(F.col("f.n") / F.col("copies")).alias("tf"), F.floor(F.col("all") / F.col("copies")).alias("dl"))


def bm25(df: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, most_terms: int = MOST_TERMS) -> DataFrame:
    """query, key, score of every text sharing a term with a query.

    Statistics are those of ``df``: filter first and they are the subset's.
    """
    asked = terms(queries, query_key, query_text).distinct()
    have = cut(hits(df, key, text, asked.select("term"), most_terms))
    stats = have.where("term IS NULL").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
    stats = stats.select("n_docs", F.greatest(F.lit(1.0), F.col("tokens") / F.greatest(F.lit(1), F.col("n_docs"))).alias("avgdl"))
    wanted = have.where("term IS NOT NULL")
    # One row per asked term, as the asked ones.
    df_t = wanted.groupBy("term").agg(F.count("*").alias("df")).join(asked, "term").crossJoin(F.broadcast(stats))
    few = asked.limit(most_terms + 1).count() <= most_terms
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return wanted.join(F.broadcast(df_t) if few else df_t, "term").groupBy(query_key, key).agg(F.round(F.sum(part), 6).alias("score"))


#: So many texts and so many queries meet in one group of ``bm25_best``.
TEXTS_AT_ONCE, QUERIES_AT_ONCE = 1 << 15, 1 << 16


def _elements(table: pa.Table, column: str) -> np.ndarray:
    return pa.concat_arrays(table.column(column).chunks).flatten().to_numpy(zero_copy_only=False)


# A term of more than this part of a block's texts has its additions in a row of a matrix; queries scored at once; texts whose greatest score is taken together.
_COMMON, _BATCH, _TOGETHER = 1 / 30, 64, 64


def _best_of(k: int, n: int, terms_: int, term: np.ndarray, doc: np.ndarray, weight: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (its terms ascending, their idf) the texts that can be among the ``k`` best of ``n``, and their scores.

    Terms are numbers below ``terms_``. ``term``, ``doc`` and ``weight`` are the postings, in the order of terms and
    texts. All texts are scored in single precision, by a matrix for common terms
    and postings for others; those that by its error may be among the best are
    added up again in double.
    """
    place = term * n + doc
    ends = np.searchsorted(term, np.arange(terms_ + 1))
    size = np.diff(ends)
    common = np.flatnonzero(size > max(k, n * _COMMON))
    row = np.full(terms_, -1)
    row[common] = np.arange(len(common))
    wide = -(-n // _TOGETHER) * _TOGETHER
    matrix = np.zeros((len(common), wide), np.float32)
    in_matrix = row[term] >= 0
    matrix[row[term[in_matrix]], doc[in_matrix]] = weight[in_matrix]
    light = weight.astype(np.float32)
    for at in range(0, len(queries), _BATCH):
        batch = queries[at : at + _BATCH]
        share = np.zeros((len(batch), len(common)), np.float32)
        for q, (of, idf) in enumerate(batch):
            r = row[of]
            share[q, r[r >= 0]] = idf[r >= 0]
        rough = share @ matrix
        for score, (of, idf) in zip(rough, batch):
            for t, w in zip(of[row[of] < 0].tolist(), idf[row[of] < 0].astype(np.float32)):
                a, b = ends[t], ends[t + 1]
                score[doc[a:b]] += w * light[a:b]
            # Of k stretches of texts each has one of at least this score.
            tops = score.reshape(-1, _TOGETHER).max(1)
            least = np.partition(tops, len(tops) - k)[len(tops) - k] if len(tops) > k else np.float32(0)
            near = np.flatnonzero(score >= least) if least > 0 else np.flatnonzero(score)
            if len(near) > k:
                some = score[near]
                least = np.partition(some, len(some) - k)[len(some) - k]
                # The sum of n positive numbers is off by n / 2 ** 24 of it at most.
                near = np.flatnonzero(score >= max(least * (1 - 4 * (len(of) + 4) / 2**24) - 2e-6, 1e-30))
            sought = (of[:, None] * n + near[None, :]).ravel()
            found = np.minimum(np.searchsorted(place, sought), max(0, len(place) - 1))
            added = np.where(place[found] == sought, weight[found], 0.0).reshape(len(of), len(near)) if len(place) else np.zeros((len(of), 0))
            yield near, idf @ added


def bm25_best(df: DataFrame, key: str, text: str, group: str, queries: DataFrame, query_key: str, query_text: str, query_group: str, k: int, most_terms: int = MOST_TERMS, texts: int = TEXTS_AT_ONCE, asking: int = QUERIES_AT_ONCE) -> DataFrame:
    """query, key, score, rank: as ``bm25``, the ``k`` best texts of each query's own group, for as many queries as texts.

    Statistics are those of ``df``, whatever the group. Texts and queries are
    taken apart where they are, into hashes of 64 bits of their terms, and meet in
    blocks of ``texts`` by ``asking``; a block gives each query its ``k`` best, so
    that the scores of all others, which grow with the square of the input, are
    neither exchanged nor kept.
    """
    listed = lambda d, c: F.transform(term_list(F.coalesce(F.col(c), F.lit(""))), lambda t: F.xxhash64(t))
    # A text whose key occurs twice counts once (the text of the least hash), as in ``hits``.
    row = F.struct(F.col(group).alias("of"), listed(df, text).alias("no"))
    have = cut(df.select(F.col(key), row.alias("r"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")).groupBy(key).agg(F.min_by("r", "h").alias("r")).select(key, F.col("r.of").alias("_group"), F.col("r.no").alias("no")))
    n_docs, tokens = have.agg(F.count("*"), F.coalesce(F.sum(F.size("no")), F.lit(0))).first()
    avgdl = max(1.0, tokens / max(1, n_docs))
    asked = queries.select(query_key, F.col(query_group).alias("_group"), F.explode(F.array_distinct(listed(queries, query_text))).alias("no"))
    idf = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    known = cut(have.select(F.explode(F.array_distinct("no")).alias("no")).groupBy("no").agg(F.count("*").alias("df")).select("no", idf.alias("idf")))
    small = F.broadcast(known) if known.limit(most_terms + 1).count() <= most_terms else known
    blocks, chunks = n_docs // texts + 1, queries.count() // asking + 1
    spread = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    held = have.select("_group", spread("_chunk", chunks), part(key, blocks).alias("_block"), key, "no")
    said = cut(asked.join(small, "no").groupBy(query_key, "_group").agg(F.collect_set(F.struct("no", "idf")).alias("p")).select(query_key, "_group", F.col("p.no").alias("no"), F.col("p.idf").alias("idf")))
    said = said.select("_group", part(query_key, chunks).alias("_chunk"), spread("_block", blocks), query_key, "no", "idf")
    kinds = dict(df.dtypes) | dict(queries.dtypes)

    def meet(asking: pa.Table, texts: pa.Table) -> pa.Table:
        empty = not asking.num_rows or not texts.num_rows
        # In the order of keys, so that of equal scores the first key comes first.
        texts = texts.sort_by(key)
        n, found, whose, scores = texts.num_rows, [], [], []
        if not empty:
            dl = pc.list_value_length(texts.column("no")).to_numpy().astype(np.int64)
            doc, no = np.repeat(np.arange(n), dl), _elements(texts, "no")
            ask, idf = _elements(asking, "no"), _elements(asking, "idf")
            names, ask = np.unique(ask, return_inverse=True)
            at = np.minimum(np.searchsorted(names, no), len(names) - 1)
            there = names[at] == no
            # Postings in the order of terms and texts, once however often a text has a term.
            place, tf = np.unique(at[there] * n + doc[there], return_counts=True)
            del no, at, there
            term, doc = place // n, place % n
            weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(asking.column("no")).to_numpy())))
            each = []
            for q in range(asking.num_rows):
                of, by = ask[ends[q] : ends[q + 1]], idf[ends[q] : ends[q + 1]]
                order = np.argsort(of)
                each.append((of[order], by[order]))
            for q, (near, value) in enumerate(_best_of(k, n, len(names), term, doc, weight, each)):
                rounded = np.round(value, 6)
                if len(near) > k:
                    keep = rounded >= np.partition(rounded, len(near) - k)[len(near) - k]
                    near, rounded = near[keep], rounded[keep]
                best = np.lexsort((near, -rounded))[:k]
                best = best[rounded[best] > 0]
                found.append(near[best])
                scores.append(rounded[best])
                whose.append(np.full(len(best), q))
        one = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return pa.table({query_key: asking.column(query_key).take(pa.array(one(whose, np.int64))), key: texts.column(key).take(pa.array(one(found, np.int64))), "score": one(scores, np.float64)})

    by = ["_group", "_chunk", "_block"]
    met = said.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(meet, f"`{query_key}` {kinds[query_key]}, `{key}` {kinds[key]}, score double")
    return top(met, query_key, "score", key, k)


def with_zeros(scores: DataFrame, queries: DataFrame, query_key: str, docs: DataFrame, key: str) -> DataFrame:
    """query, key, score of every text for a stated set of queries, 0 where no term is shared."""
    every = F.broadcast(queries.select(query_key).distinct()) if queries.limit(1001).count() <= 1000 else queries.select(query_key).distinct()
    return docs.select(key).distinct().crossJoin(every).join(scores, [query_key, key], "left").select(query_key, key, F.coalesce("score", F.lit(0.0)).alias("score"))


def top(df: DataFrame, partition: str | list[str], score: str, tie: str, k: int, name: str = "rank") -> DataFrame:
    """The ``k`` best of each partition with their rank."""
    w = W.partitionBy(*([partition] if isinstance(partition, str) else partition)).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def unit(v: Column) -> Column:
    """Vector of length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_scores(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, best: int | None = None, block: int = 256, most: int = 20_000) -> DataFrame:
    """query, key, score: every vector against a stated set of queries, in blocks.

    The queries go to all tasks, ``most`` at a time; each batch of vectors meets
    them as matrices of ``block``, and the vectors aren't moved. With ``best`` a
    batch gives only those of its vectors that are among its ``best`` for a query
    (or tie with the last), which are all that can be so among all vectors.
    """
    asked = queries.select(query_key, query_vector).where(F.col(query_vector).isNotNull())
    n = asked.count()
    # A set larger than one round is parted by hash, so that the driver holds one part.
    rounds = max(1, -(-n // most))
    part_of = F.pmod(F.xxhash64(query_key), F.lit(rounds))
    kinds, result = dict(vectors.dtypes), None
    out = f"{query_key} {dict(queries.dtypes)[query_key]}, {key} {kinds[key]}, score double"
    for r in range(rounds):
        part = (asked if rounds == 1 else asked.where(part_of == r)).toPandas()
        q = np.array([np.asarray(v, np.float64) for v in part[query_vector]]) if len(part) else np.zeros((0, 1))
        shared = vectors.sparkSession.sparkContext.broadcast((part[query_key].to_numpy(), q))

        def score(batches, shared=shared):
            ids, q = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                v = np.stack([np.asarray(x, np.float64) for x in pdf[vector]])
                names = pdf[key].to_numpy()
                for at in range(0, len(ids), block):
                    s = np.round(v @ q[at : at + block].T, 6)
                    keep = np.ones(s.shape, bool) if best is None or len(s) <= best else s >= np.partition(s, len(s) - best, axis=0)[len(s) - best]
                    row, col = np.nonzero(keep)
                    yield pd.DataFrame({query_key: ids[at + col], key: names[row], "score": s[row, col]})

        one = vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(score, out)
        result = one if result is None else result.unionByName(one)
    return result


def tier(kind: Column) -> Column:
    """Authority tier of a kind of work."""
    return F.when(kind == "canonical", "canonical").when(kind == "reference", "reference").otherwise("recollections")


def tier_weight(intent: Column, tier_: Column, primary: Column) -> Column:
    """What intent and tier add to a score; unknown intents weigh as ``unknown``."""
    out = None
    for name, (canonical, recollections, reference) in TIER_WEIGHTS.items():
        w = F.when(tier_ == "canonical", canonical).when(tier_ == "reference", reference).otherwise(recollections)
        out = F.when(intent == name, w) if out is None else out.when(intent == name, w)
    last = TIER_WEIGHTS["unknown"]
    base = out.otherwise(F.when(tier_ == "canonical", last[0]).when(tier_ == "reference", last[2]).otherwise(last[1]))
    return base + F.when((tier_ == "canonical") & primary, PRIMARY_BONUS).otherwise(0.0)


def ranked(scores: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """``scores`` with r: places 1 to n within ``by``, best first."""
    return scores.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), F.asc(key))))


def fuse(rankings: DataFrame, query: str, key: str, lists: str, score: str, k: int = RRF_K) -> DataFrame:
    """query, key, fused: reciprocal ranks summed over the lists; scores of 0 or less aren't ranked in list ``lexical``."""
    places = ranked(rankings.where((F.col(lists) != "lexical") | (F.col(score) > 0)), [query, lists], score, key)
    return places.groupBy(query, key).agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("fused"))


def fused_candidates(dense: DataFrame, lexical: DataFrame, about: DataFrame, query: str, key: str, intents: DataFrame, candidates: int = 100, weigh_quality: bool = False) -> DataFrame:
    """query, key, fused, rank: the pool that is diversified later.

    dense(query, variant, key, score) holds a score list per variant of a query,
    lexical(query, key, score) the best lexical score over its variants,
    about(key, kind, is_primary, quality) what is known of a text and
    intents(query, intent) what is asked for. Intent and tier weigh every dense
    score before it is ranked; fused scores get the bonus of primary canonical
    texts and are multiplied by quality if asked to.
    """
    known = about.select(key, tier(F.col("kind")).alias("tier"), F.coalesce("is_primary", F.lit(False)).alias("is_primary"), "quality")
    weighed = dense.join(known, key).join(intents, query).select(query, key, F.col("variant").cast("string").alias("list"), F.round(F.col("score") + tier_weight(F.col("intent"), F.col("tier"), F.col("is_primary")), 6).alias("score"))
    fused = fuse(weighed.unionByName(lexical.select(query, key, F.lit("lexical").alias("list"), "score")), query, key, "list", "score")
    bonus = F.when((F.col("tier") == "canonical") & F.col("is_primary"), FUSED_BONUS).otherwise(0.0)
    quality = F.coalesce("quality", F.lit(1.0)) if weigh_quality else F.lit(1.0)
    final = fused.join(known, key).select(query, key, F.round((F.col("fused") + bonus) * quality, 9).alias("fused"))
    return top(final, query, "fused", key, candidates)


def mmr(candidates: DataFrame, query: str, key: str, work: str, score: str, vector: str, k: int = 12, balance: float = 0.7, cap: int = 2, duplicate: float = DUPLICATE) -> DataFrame:
    """query, key, pick, mmr: greedy choice of relevant and different candidates.

    A candidate is passed over when its work has ``cap`` picks or it is a duplicate
    of any pick; the penalty is its closeness to picks of the same work. Input is
    the top of each query (a hundred rows), so a group is small.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        v = np.stack([np.asarray(x, np.float64) for x in pdf[vector]])
        close, s, w = v @ v.T, pdf[score].to_numpy(), pdf[work].to_numpy()
        left, picks, values = list(range(len(pdf))), [], []
        while left and len(picks) < k:
            best, value = None, -np.inf
            for i in left:
                same = [p for p in picks if w[p] == w[i]]
                if len(same) >= cap or any(close[i, p] >= duplicate for p in picks):
                    continue
                x = balance * s[i] - (1 - balance) * max((close[i, p] for p in same), default=0.0)
                if x > value:
                    best, value = i, x
            if best is None:
                break
            left.remove(best)
            picks.append(best)
            values.append(round(float(value), 6))
        return pd.DataFrame({query: pdf[query].iloc[0] if len(pdf) else [], key: pdf[key].iloc[picks].to_numpy(), "pick": range(1, len(picks) + 1), "mmr": values})

    kinds = dict(candidates.dtypes)
    return candidates.select(query, key, work, score, vector).groupBy(query).applyInPandas(choose, f"{query} {kinds[query]}, {key} {kinds[key]}, pick int, mmr double")


def parents_of(ranked: DataFrame, query: str, rank: str, parent: str, work: str, k: int, per_work: int, per_parent: int) -> DataFrame:
    """query, parent, place, children: the first ``k`` distinct parents by their best child, at most ``per_work`` of a work."""
    first = ranked.groupBy(query, parent, work).agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    in_work = F.row_number().over(W.partitionBy(query, work).orderBy("best"))
    place = F.row_number().over(W.partitionBy(query).orderBy("best"))
    return first.withColumn("in_work", in_work).where(F.col("in_work") <= per_work).withColumn("place", place).where(F.col("place") <= k).select(query, parent, work, "place", F.least("n", F.lit(per_parent)).alias("children"))
