"""Quality rules: base rules, and the hashed n-gram log-likelihood ratio of two multinomials. Native.

Word unigrams and bigrams are hashed into BUCKETS buckets. The raw multinomial is counted over all
documents, the target one over all documents labelled good and not toxic; both are add-one smoothed. A document's score is the mean over
its n-grams of log(p_target / p_raw); it is kept when it passes the base rules and its score is at
least the threshold. That follows from the held-out good documents: a ratio with only one half of the
target documents (by hash of doc_id) scores the other half, of which those that pass the base rules
count. It is the highest score that keeps KEEP of them, less MARGIN standard errors of their mean, at
every size; without any there is nothing to judge by and no document is rejected by its score. The
same rows always give the same verdict. Where there is no target document every score is 0.

A mean over a whole text does not see a few words of abuse, so a second ratio looks at passages of
one word: log((toxic + EVEN) / (s * clean + EVEN)) of a word's bucket, over the documents labelled
toxic and those labelled not toxic that hold it, s making their masses equal.
Words are lower-cased and freed of punctuation at their ends; each is hashed to two buckets and the
lower ratio counts, so a word that shares one bucket with a toxic word is not taken for it. A
document's peak is its highest ratio, 0 at least, and it is rejected above the limit, which follows
from held-out clean documents as the threshold does: one half of the labels, with half the smoothing,
judges the other. Without toxic labels all peaks are 0, without held-out clean ones there is no limit.

Each text is scored where it lies: the ratios are three lists of BUCKETS whole numbers, which the
executors work out from the counts, constants of the plan that it does not spell out. For counting and for fitting, documents are joined with the ids of all labelled ones, which
Spark broadcasts while they are few and shuffles else.

Null text has no words and fails the base rules. Repeated rows are counted and returned as often as
they occur. A column of docs named like one of the computed columns is replaced by it. A text is worked
on whole in one task, so it must fit there some ten times over. An empty table gives an empty one.
"""
from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, words

#: A power of two.
BUCKETS = 1 << 16
#: Share of held-out good documents that the threshold keeps.
KEEP = 0.999
#: Standard errors of the held-out mean that the threshold lies below the lowest score kept: few documents tell little.
MARGIN = 4
MIN_WORDS = 50
MAX_REPEAT = 50
#: Documents that a word's odds of being toxic are smoothed by.
EVEN = 2
#: What is taken off the ends of words before their odds are looked up.
ENDS = ".,;:!?\"'()[]"
#: Scores are sums of whole parts of SCALE, which do not depend on the order of addition.
SCALE = 1_000_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hashed(docs: DataFrame):
    """docs with _w, its words, _h, the hashes of these in lower case, and _b, those of the bigrams that begin at them; the last word is a bigram with an end."""
    d = docs.withColumn("_w", words(F.col("text"))).withColumn("_h", F.expr("transform(_w, x -> xxhash64(lower(x)))"))
    return d.withColumn("_b", F.expr("zip_with(_h, slice(_h, 2, size(_h)), (x, y) -> xxhash64(x, coalesce(y, 0L)))"))


def _one(h):
    """The bucket of a unigram or bigram."""
    return h.bitwiseAND(F.lit(BUCKETS - 1))


def _keys(words_):
    """The hashes of the different words, under which odds are kept."""
    return F.transform(F.array_distinct(words_), lambda w: F.xxhash64(F.btrim(F.lower(w), F.lit(ENDS))))


def _bucket(key, nth: int):
    """A key's bucket in the first or the second table."""
    return _one(F.shiftright(key, 20 * nth) if nth else key)


def _variable(spark, numbers: str) -> str:
    """A new session variable of the array of numbers. It folds to a constant that is packed and has no text: as a
    literal its digits are copied at every level of an expression whenever the driver describes a plan."""
    name = f"tidewatch_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE VARIABLE {name} ARRAY<BIGINT>")
    spark.sql(f"SET VARIABLE {name} = cast(split(:numbers, ',') AS ARRAY<BIGINT>)", {"numbers": numbers})
    return name


def _with(constant: str, use):
    """use(the array of a variable), which stands in the plan once however often it is looked up."""
    return F.get(F.transform(F.array(F.expr(constant)), use), F.lit(0))


def _listed(d: DataFrame, *columns: str) -> list[str]:
    """Each column's whole numbers in the order of g, joined by commas: one string each for the driver, not a row for every g."""
    return list(d.agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", c))), lambda x: x[c]), ",") for c in columns]).first())  # noqa: B023


def measured(docs: DataFrame, ratio: str | None = None, odds: list[str] | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, peak and base_failed; with only these of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.drop(*BASE, "score", "peak", "base_failed")
    own = d.columns
    d = _hashed(d)
    d = d.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\v\f\r")) != ""))
    # a 3-word window found again is one in lower case too, which its two bigrams tell
    d = d.withColumn("_t", F.expr("""zip_with(slice(_b, 1, greatest(size(_b) - 2, 0)), slice(_b, 2, greatest(size(_b) - 2, 0)), (x, y) -> x ^ shiftleft(y, 1))"""))
    # where any may be: longs of half of this and the start, sorted; those beside an equal half may be found again
    d = d.withColumn("_s", F.expr("""if(size(array_distinct(_t)) = size(_t), slice(_t, 1, 0),
        sort_array(transform(_t, (h, i) -> (h & -4294967296L) | i)))"""))
    d = d.withColumn("_c", F.expr("""filter(_s, (x, k) -> (k > 0 and shiftright(_s[k - 1], 32) = shiftright(x, 32))
        or (k < size(_s) - 1 and shiftright(_s[k + 1], 32) = shiftright(x, 32)))"""))
    # the hashes of these windows' words decide: (hash, start) pairs sorted, so that one found again stands beside its equal
    d = d.withColumn("_p", F.expr("""array_sort(transform(transform(_c, x -> cast(x & 4294967295L as int)),
        i -> named_struct('h', xxhash64(_w[i], _w[i + 1], _w[i + 2]), 'i', i)))"""))
    d = d.withColumn("_i", F.expr("""if(size(_p) = 0, cast(array() as array<int>), array_sort(transform(filter(_p, (x, k) ->
        (k > 0 and _p[k - 1].h = x.h) or (k < size(_p) - 1 and _p[k + 1].h = x.h)), x -> x.i)))"""))
    covered = "cast(aggregate(_i, named_struct('end', 0, 'n', 0), (a, i) -> named_struct('end', i + 3, 'n', a.n + i + 3 - greatest(a.end, i)), a -> a.n) as long)"
    score = peak = F.lit(0.0)
    constants = [_variable(docs.sparkSession, numbers) for numbers in ([] if ratio is None else [ratio]) + list(odds or [])]
    if ratio is not None:
        total = lambda of, c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.get(of, _one(x)))
        score = _with(constants[0], lambda of: total(of, "_h") + total(of, "_b")) / F.greatest(2 * F.size("_h"), F.lit(1)) / SCALE
    if odds is not None:
        # a peak is 0 at least, so keys that the first table does not raise above 0 cannot matter
        second = F.expr(constants[-1])
        raised = lambda first: F.filter(_keys(F.col("_w")), lambda k: F.get(first, _bucket(k, 0)) > 0)
        lower = lambda first: F.transform(raised(first), lambda k: F.least(F.get(first, _bucket(k, 0)), F.get(second, _bucket(k, 1))))
        peak = F.greatest(F.coalesce(_with(constants[-2], lambda first: F.array_max(lower(first))), F.lit(0)), F.lit(0)) / SCALE
    # a generator's output: a filter on these columns must not carry the expressions to the scan
    each = (
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        score.alias("score"),
        peak.alias("peak"),
    )
    names = (*BASE, "score", "peak")
    d = d.select(*own, F.inline(F.array(F.struct(*[c for n, c in zip(names, each) if only is None or n in only]))))
    for name in constants:  # the analysed plan holds their values
        docs.sparkSession.sql(f"DROP TEMPORARY VARIABLE {name}")
    return d if only is not None and "base_failed" not in only else d.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words"))


def target(labels: DataFrame) -> DataFrame:
    """(_d, _half): the ids of the trusted documents; _half is null for the held-out ones."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_d")).distinct()
    return good.withColumn("_half", F.expr("if(pmod(xxhash64(_d, 5), 2) = 0, 1, null)"))


def ratios(docs: DataFrame, good: DataFrame) -> tuple[str, str]:
    """The ratio of every bucket in parts of SCALE, and that with one half of good, from target(); see _listed()."""
    d = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("_d"), "left")
    # the hashes come from a generator, or the filter of explode would work them out again for every word
    g = _hashed(d).select("_d", "_half", F.inline(F.array(F.struct(F.concat("_h", "_b").alias("_g")))))
    n = cut(g.select("_d", "_half", F.explode("_g").alias("g")).groupBy(_one(F.col("g")).alias("g")).agg(F.count("*").alias("raw"), F.count("_d").alias("own"), F.count("_half").alias("half")))
    total, *masses = n.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("raw", "own", "half")]).first()
    n = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "g").join(n, "g", "left").fillna(0)

    def of(c, all_):
        one = lambda x, mass: F.log((F.col(x) + 1) / F.lit(mass + BUCKETS))
        return (F.rint(SCALE * (one(c, all_) - one("raw", total))) if all_ else F.lit(0)).cast("long").alias(c)

    return tuple(_listed(n.select("g", *map(of, ("own", "half"), masses)), "own", "half"))


def labelled(labels: DataFrame) -> DataFrame:
    """(_d, _toxic, _half): ids labelled toxic by any row, and those labelled not toxic only; _half as in target()."""
    d = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_d")).agg((F.max("toxic") == 1).alias("_toxic"))
    return d.withColumn("_half", F.pmod(F.xxhash64("_d", F.lit(5)), F.lit(2)) == 0)


def toxic_odds(docs: DataFrame, known: DataFrame) -> tuple[list[str], list[str]]:
    """Both tables of odds in parts of SCALE, and those of one half of known, from labelled(); see _listed()."""
    # a column of its own, or each of the two uses would work the keys out
    d = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_d")).withColumn("_k", _keys(words(F.col("text"))))
    # the second table's buckets follow those of the first
    first, second = F.transform("_k", lambda x: _bucket(x, 0)), F.transform("_k", lambda x: _bucket(x, 1) + BUCKETS)
    g = d.select("_toxic", "_half", F.inline(F.array(F.struct(F.array_distinct(F.concat(first, second)).alias("_b"))))).select("_toxic", "_half", F.explode("_b").alias("g"))
    bad, half = F.col("_toxic"), F.col("_half")
    counts = {"toxic": bad, "toxic_half": bad & half, "clean": ~bad, "clean_half": ~bad & half}
    n = cut(g.groupBy("g").agg(*[F.count_if(c).alias(name) for name, c in counts.items()]))
    n = docs.sparkSession.range(2 * BUCKETS).withColumnRenamed("id", "g").join(n, "g", "left").fillna(0).withColumn("nth", F.floor(F.col("g") / BUCKETS))
    mass = {m.nth: m for m in n.groupBy("nth").agg(*[F.sum(name).alias(name) for name in counts]).collect()}
    out = []
    for fine, toxic, even in (("clean", "toxic", EVEN), ("clean_half", "toxic_half", EVEN / 2)):
        for nth in (0, 1):
            scale = mass[nth][toxic] / max(mass[nth][fine], 1)
            of = F.rint(SCALE * F.log((F.col(toxic) + even) / (F.col(fine) * F.lit(scale) + even))) if mass[0]["toxic"] else F.lit(0)  # else nothing to tell by
            out += _listed(n.where(F.col("nth") == nth).select("g", of.cast("long").alias("v")), "v")
    return out[:2], out[2:]


def limit(docs: DataFrame, known: DataFrame, half: list[list[int]]) -> float:
    """The limit that keeps KEEP of the held-out clean documents, with MARGIN; infinity without any."""
    held = docs.select("doc_id", "text").join(known.where("not _toxic and not _half"), F.col("doc_id") == F.col("_d"), "left_semi")
    s = cut(measured(held, None, half, only=("peak",)).select("peak"))
    n, spread = s.agg(F.count("*"), F.stddev_pop("peak")).first()
    lost = int(round(n * (1 - KEEP), 6))
    return s.orderBy(F.desc("peak")).limit(lost + 1).agg(F.min("peak")).first()[0] + MARGIN * round(spread, 6) / math.sqrt(n) if n else math.inf


def fit(docs: DataFrame, good: DataFrame, half: list[int]) -> float:
    """The threshold that keeps KEEP of the held-out good documents, with MARGIN; minus infinity without any."""
    held = docs.select("doc_id", "text").join(good.where("_half is null"), F.col("doc_id") == F.col("_d"), "left_semi")
    s = cut(measured(held, half, only=("n_words", "n_repeat_words", "score", "base_failed")).where("not base_failed").select("score"))
    n, spread = s.agg(F.count("*"), F.stddev_pop("score")).first()
    lost = int(round(n * (1 - KEEP), 6))
    return s.orderBy("score").limit(lost + 1).agg(F.max("score")).first()[0] - MARGIN * round(spread, 6) / math.sqrt(n) if n else -math.inf


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None, highest: float | None = None) -> DataFrame:
    """docs with the base columns, score, peak, base_failed and kept; threshold and limit are fitted unless they are given."""
    good, known = cut(target(labels)), cut(labelled(labels))
    ratio, half = ratios(docs, good)
    odds, half_odds = toxic_odds(docs, known)
    if threshold is None:
        threshold = fit(docs, good, half)
    if highest is None:
        highest = limit(docs, known, half_odds)
    fine = (F.col("score") >= threshold) & (F.col("peak") <= highest)
    return measured(docs.drop("kept"), ratio, odds).withColumn("kept", ~F.col("base_failed") & fine)


def op5_quality(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "peak")


def quality_base(spark, sf_dir):
    """The base columns, which SQL can express."""
    return measured(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *BASE, "base_failed")


ORACLES = {"quality_base": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
 g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
 again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
 inside AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(n, 0) > 50 * len(ws) AS base_failed
FROM d LEFT JOIN inside USING (r)"""}
