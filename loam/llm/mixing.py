"""Mixing sources to target weights by iterative proportional fitting and calibrated sampling.

The tokens of every (source, language, topic) cell are counted over all documents.  Raking scales the
cells to the target shares of each source, then of each language, then of each topic, again and again; the
raked mass of a cell over its tokens is the calibrated probability of its documents, but for one common
factor, set so that the expected tokens kept are the wanted share and no probability exceeds 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import table, with_struct

#: Share of all tokens to keep, in expectation.
KEEP = 0.7
#: Default targets: each value's share of tokens to this power, then normalised, which lifts rare values.
TEMPER = 0.7
ROUNDS, SEED, NONE = 50, 7, "(none)"
#: Cells up to which their probabilities are broadcast (some 10 MB); more are joined by their keys, as Spark sees fit.
BROADCAST_CELLS = 100_000
DIMS = ("source", "lang", "topic")
FIELDS = ["topic", "tokens", "probability", "kept"]


def topic_of(text: Column) -> Column:
    """Coarse topic of tables that lack one, from the whole text: table, figures, prose, or (none) for blank and null."""
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, NONE).when(F.contains(text, F.lit("|")), "table").when(text.rlike("[0-9]"), "figures").otherwise("prose")


def tempered(mass: np.ndarray, of: np.ndarray, temper: float = TEMPER) -> np.ndarray:
    """Target share of each value (index in ``of``): its share of ``mass`` to the power ``temper``, normalised."""
    total = np.bincount(of, mass)
    lifted = np.where(total > 0, (total / max(total.sum(), 1e-300)) ** temper, 0)
    return lifted / max(lifted.sum(), 1e-300)


def rake(mass: np.ndarray, indexes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Cell masses fitted in turn to each dimension's target shares; a value without mass or target gets none."""
    w = mass.astype(float)
    for _ in range(rounds):
        for of, share in zip(indexes, targets):
            now = np.bincount(of, w, minlength=len(share))
            w = w * np.where(now > 0, share / np.where(now > 0, now, 1), 0)[of]
    return w


def probabilities(mass: np.ndarray, raked: np.ndarray, keep: float = KEEP) -> np.ndarray:
    """min(1, f * raked / mass) with f such that the expected mass is ``keep`` of all; cells without mass have 1."""
    ratio = np.where(mass > 0, raked / np.where(mass > 0, mass, 1), 0)
    order = np.argsort(-ratio, kind="stable")
    m, w = mass[order], raked[order]
    before_m, before_w = np.cumsum(m) - m, np.cumsum(w) - w
    rest = w.sum() - before_w
    factor = np.where(rest > 1e-12, (keep * mass.sum() - before_m) / np.where(rest > 1e-12, rest, 1), np.inf)
    fits = np.flatnonzero(np.isfinite(factor) & (np.where(np.isfinite(factor), factor, 0) * ratio[order] <= 1))
    f = factor[fits[0]] if len(fits) else np.inf
    return np.where(mass > 0, np.minimum(1.0, np.where(ratio > 0, f * np.where(ratio > 0, ratio, 1), 0.0)), 1.0)


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """Uniform in [0, 1) from the id (from the text where that is null), alike on every run."""
    name = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, topic: Column | None = None, seed: int = SEED) -> DataFrame:
    """Append topic, tokens (words), probability and kept to every row.

    ``targets`` may give the share of each value of source, lang or topic; values left out get none, and a
    dimension left out gets its tempered shares.  Null in a dimension is the value (none).  Null and blank
    texts have no tokens and weigh nothing, but share their cell's probability (1 in a cell without tokens).
    Rows of one id are drawn alike; a null id is drawn by its text.  Other columns stay, except those with
    an output's name, which it replaces.  An empty table gives an empty table.  Only the cells' sums come to
    the driver, one row for each combination that occurs.
    """
    text = F.col("text")
    keys = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic_of(text) if topic is None else topic.cast("string")}
    words = F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")
    hidden = [f"__loam_{d}__" for d in DIMS]
    named = docs.withColumns({h: F.coalesce(keys[d], F.lit(NONE)) for h, d in zip(hidden, DIMS)})
    cells = sorted(tuple(r) for r in named.groupBy(*hidden).agg(F.sum(words)).collect())
    mass = np.array([c[3] for c in cells], float)
    indexes, shares = [], []
    for k, d in enumerate(DIMS):
        values, of = np.unique(np.array([c[k] for c in cells], dtype=object), return_inverse=True)
        wanted = (targets or {}).get(d)
        share = np.array([wanted.get(v, 0.0) for v in values], float) if wanted is not None else tempered(mass, of)
        indexes.append(of)
        shares.append(share / max(share.sum(), 1e-300))
    p = probabilities(mass, rake(mass, indexes, shares), keep) if cells else np.zeros(0)
    rows = [(*c[:3], float(x)) for c, x in zip(cells, p)]
    chances = docs.sparkSession.createDataFrame(rows, ", ".join(f"{h} string" for h in hidden) + ", __loam_p__ double")
    if len(rows) <= BROADCAST_CELLS:
        chances = F.broadcast(chances)
    drawn = draw(F.col("doc_id"), text, seed) < F.col("__loam_p__")
    made = F.struct(F.col(hidden[2]).alias("topic"), words.alias("tokens"), F.round("__loam_p__", 6).alias("probability"), drawn.alias("kept"))
    return with_struct(named.join(chances, hidden, "left"), made, FIELDS).drop(*hidden, "__loam_p__")


def keep_mixed(docs: DataFrame) -> DataFrame:
    """The drawn rows of ``docs``, with its own columns; nulls, repeats, ties and empty tables as in ``mix``."""
    return mix(docs.withColumn("__loam_row__", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))).where("kept").select("__loam_row__.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).drop("text")


MIXING_SQL = f"""
with recursive named as (
  select doc_id, source as source_given, lang as lang_given, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang, text,
    case when text is null or trim(text) = '' then '{NONE}' when contains(text, '|') then 'table'
         when regexp_matches(text, '[0-9]') then 'figures' else 'prose' end as topic,
    coalesce(len(regexp_extract_all(text, '\\S+')), 0)::bigint as tokens
  from documents
), cells as (
  select source, lang, topic, sum(tokens)::double as mass from named group by all
), shares as (
  select 'source' as dim, source as v, power(sum(mass) / (select sum(mass) from cells), {TEMPER}) as lifted from cells group by source
  union all select 'lang', lang, power(sum(mass) / (select sum(mass) from cells), {TEMPER}) from cells group by lang
  union all select 'topic', topic, power(sum(mass) / (select sum(mass) from cells), {TEMPER}) from cells group by topic
), target as (
  select dim, v, lifted / sum(lifted) over (partition by dim) as share from shares
), wide as (
  select c.*, s.share as s_source, l.share as s_lang, t.share as s_topic
  from cells c join target s on s.dim = 'source' and s.v = c.source join target l on l.dim = 'lang' and l.v = c.lang
    join target t on t.dim = 'topic' and t.v = c.topic where c.mass > 0
), rake as (
  select 0 as k, source, lang, topic, mass, s_source, s_lang, s_topic, mass as w from wide
  union all
  select k + 1, source, lang, topic, mass, s_source, s_lang, s_topic, w2 * s_topic / sum(w2) over (partition by topic)
  from (select *, w1 * s_lang / sum(w1) over (partition by lang) as w2
        from (select *, w * s_source / sum(w) over (partition by source) as w1 from rake where k < {ROUNDS}))
), raked as (
  select source, lang, topic, mass, w, w / mass as ratio from rake where k = {ROUNDS}
), ordered as (
  select *, coalesce(sum(mass) over before, 0) as before_m, sum(w) over () - coalesce(sum(w) over before, 0) as rest,
    row_number() over (order by ratio desc, source, lang, topic) as place
  from raked window before as (order by ratio desc, source, lang, topic rows between unbounded preceding and 1 preceding)
), factors as (
  select *, ({KEEP} * (select sum(mass) from cells) - before_m) / rest as f from ordered
), chosen as (
  select f from factors where f * ratio <= 1 order by place limit 1
), chances as (
  select source, lang, topic, least(1.0, (select f from chosen) * ratio) as p from raked
)
select doc_id, source_given as source, lang_given as lang, n.topic, tokens, round(coalesce(p, 1.0), 6) as probability,
  ('0x' || substr(md5(coalesce(doc_id::varchar, text, '') || ':{SEED}'), 1, 8))::bigint / 4294967296.0 < coalesce(p, 1.0) as kept
from named n left join chances c on n.source = c.source and n.lang = c.lang and n.topic = c.topic
"""
