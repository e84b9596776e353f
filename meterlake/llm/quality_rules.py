"""Weak supervision: rules vote or abstain, EM estimates how far to trust each, a posterior decides.

DataFrame functions on all rows. What reaches the driver is one count for each pattern of votes, at
most 3 ** len(RULES) rows at any input size; EM runs over those counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table
from .text_stats import STATS, document_stats

ITERATIONS = 25
#: What is believed before any vote is seen, as so many documents for each document of the table:
#: the share of good ones, and the probabilities of a vote (bad, abstains, good) on bad and on good ones.
BELIEF = 0.1
PRIOR_GOOD = 0.85
ON_BAD, ON_GOOD = (0.3, 0.2, 0.5), (0.01, 0.2, 0.79)

#: name: (SQL condition for a bad vote, for a good vote); neither: the rule abstains. Over STATS; n_words is above 0.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "letters": ("5 * n_letters < 4 * word_chars", "10 * n_letters >= 9 * word_chars"),
    "marks": ("10 * n_marks > n_words", "50 * n_marks <= n_words"),
    "capitals": ("10 * n_upper > 3 * word_chars", "10 * n_upper < word_chars"),
    "exclaims": ("5 * n_exclaims > n_words", "50 * n_exclaims <= n_words"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    "repeats": ("10 * n_repeat_words > n_words", "50 * n_repeat_words <= n_words"),
    "word_length": ("2 * word_chars < 7 * n_words OR word_chars > 9 * n_words", "word_chars >= 4 * n_words AND word_chars <= 7 * n_words"),
    "sentences": ("n_words >= 30 AND 100 * n_stops < n_words", "50 * n_stops >= n_words AND 3 * n_stops <= n_words"),
    "vocabulary": ("n_words >= 30 AND n_words < 2000 AND 10 * n_distinct_words < 3 * n_words", "n_words < 2000 AND 2 * n_distinct_words > n_words"),
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def vote_sql(bad: str, good: str) -> str:
    return f"CASE WHEN n_words = 0 THEN 1 WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END"


def with_votes(stats: DataFrame) -> DataFrame:
    """stats and a column v_<rule> for each rule: 0 bad, 1 abstains, 2 good. A text without words gets no votes."""
    return stats.select("*", *(F.expr(vote_sql(*c)).alias(f"v_{name}") for name, c in RULES.items()))


def fit(votes: DataFrame, iterations: int = ITERATIONS) -> dict:
    """EM over the counts of vote patterns.

    Each rule has, for good and for bad documents, probabilities of its three votes. A weak belief
    in what votes mean keeps the two classes from being any other two clusters; a table without
    rows leaves that belief. Returns prior (log odds) and weights[rule][vote], the log odds that a
    vote adds.
    """
    rules = list(RULES)
    counts = [(tuple(r[:-1]), r[-1]) for r in votes.groupBy(*(f"v_{x}" for x in rules)).agg(F.count("*").alias("n")).collect()]
    believed = BELIEF * sum(n for _, n in counts)
    share = (1 - PRIOR_GOOD, PRIOR_GOOD)  # bad, good
    prior, weights = math.log(share[1] / share[0]), {x: [math.log(g / b) for b, g in zip(ON_BAD, ON_GOOD)] for x in rules}
    for _ in range(iterations if counts else 0):
        mass = [believed * s for s in share]
        seen = {x: [[believed * s * p for p in on] for s, on in zip(share, (ON_BAD, ON_GOOD))] for x in rules}
        for pattern, n in counts:
            good = n / (1 + math.exp(-(prior + sum(weights[x][v] for x, v in zip(rules, pattern)))))
            for k, part in enumerate((n - good, good)):
                mass[k] += part
                for x, v in zip(rules, pattern):
                    seen[x][k][v] += part
        prior = math.log(mass[1] / mass[0])
        weights = {x: [math.log(seen[x][1][v] / mass[1]) - math.log(seen[x][0][v] / mass[0]) for v in range(3)] for x in rules}
    return {"prior": prior, "weights": weights}


def posterior(model: dict) -> Column:
    odds = F.lit(model["prior"])
    for name, w in model["weights"].items():
        v = F.col(f"v_{name}")
        odds = odds + F.when(v == 0, F.lit(w[0])).when(v == 1, F.lit(w[1])).otherwise(F.lit(w[2]))
    return 1 / (1 + F.exp(-odds))


def judge(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, STATS, votes, base_failed, quality_probability and kept for every row of df.

    Null and empty texts have no words: base_failed, not kept. Repeated rows are judged alike, an
    empty table gives no rows, and columns of df other than key and text are ignored.
    """
    votes = materialize(with_votes(document_stats(df, text, (key,))), "votes")
    model = fit(votes)
    failed = F.expr(BASE_FAILED)
    out = votes.withColumns({"base_failed": failed, "quality_probability": posterior(model)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= 0.5))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *STATS[:3], "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality_probability", 3).alias("quality_probability"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that the rules keep.

    The rows are written once with their votes, as EM needs all votes before any row is judged.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    votes = materialize(with_votes(document_stats(rows, "_text", ("_row",))), "voted-rows")
    model = fit(votes)
    return votes.filter(~F.expr(BASE_FAILED) & (posterior(model) >= 0.5)).select("_row.*")


def _em_sql() -> str:
    """The EM iterations, one common table expression each."""
    rules = list(RULES)
    at = lambda x, side: f"CASE v_{x} WHEN 0 THEN {side}.w_{x}_0 WHEN 1 THEN {side}.w_{x}_1 ELSE {side}.w_{x}_2 END"
    odds = lambda side: f"{side}.prior + " + " + ".join(at(x, side) for x in rules)
    first = ", ".join(f"ln({g}::DOUBLE / {b}) AS w_{x}_{v}" for x in rules for v, (b, g) in enumerate(zip(ON_BAD, ON_GOOD)))
    parts = [f"m0 AS MATERIALIZED (SELECT ln({PRIOR_GOOD}::DOUBLE / {1 - PRIOR_GOOD}) AS prior, {first})"]
    for i in range(ITERATIONS):
        bad, good = f"({BELIEF * (1 - PRIOR_GOOD)} * sum(n) + sum(n - g))", f"({BELIEF * PRIOR_GOOD} * sum(n) + sum(g))"
        seen = lambda x, v, share, p, part: f"({BELIEF * share * p} * sum(n) + coalesce(sum({part}) FILTER (v_{x} = {v}), 0))"
        logs = ", ".join(f"ln({seen(x, v, PRIOR_GOOD, ON_GOOD[v], 'g')} / {good}) - ln({seen(x, v, 1 - PRIOR_GOOD, ON_BAD[v], 'n - g')} / {bad}) AS w_{x}_{v}" for x in rules for v in range(3))
        parts.append(f"m{i + 1} AS MATERIALIZED (SELECT ln({good} / {bad}) AS prior, {logs} FROM (SELECT p.*, n / (1 + exp(-({odds('m')}))) AS g FROM patterns p, m{i} m))")
    final = odds("m")
    return ",\n".join(parts), final


_PARTS, _ODDS = _em_sql()
OP3_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS MATERIALIZED (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS l,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS f FROM t),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM a WHERE len(w) >= 5),
named AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM windows),
twice AS (SELECT doc_id, i FROM named QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
marked AS (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM twice),
repeats AS (SELECT doc_id, count(*) AS n FROM marked GROUP BY 1),
stats AS MATERIALIZED (
  SELECT a.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(f) - len(list_distinct(f)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(list_distinct(w))::BIGINT AS n_distinct_words,
         len(regexp_extract_all(t, '[A-Z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{DE}}]'))::BIGINT AS n_upper,
         len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaims, len(regexp_extract_all(t, '[.?]'))::BIGINT AS n_stops,
         len(regexp_extract_all(t, '\p{{L}}'))::BIGINT AS n_letters,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]')))::BIGINT AS n_marks
  FROM a LEFT JOIN repeats r USING (doc_id)),
votes AS MATERIALIZED (SELECT *, {", ".join(f"{vote_sql(*c)} AS v_{x}" for x, c in RULES.items())} FROM stats),
patterns AS MATERIALIZED (SELECT {", ".join(f"v_{x}" for x in RULES)}, count(*)::DOUBLE AS n FROM votes GROUP BY ALL),
{_PARTS},
judged AS (
  SELECT v.*, ({BASE_FAILED}) AS base_failed, 1 / (1 + exp(-({_ODDS}))) AS p FROM votes v, m{ITERATIONS} m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND p >= 0.5 AS kept, round(p, 3) AS quality_probability
FROM judged
"""
