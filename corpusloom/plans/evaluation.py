"""Evaluation analytics over labelled documents.

Labels of three levels come from labels.quality and labels.toxic; a deterministic rule plays the model, and fails on some rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import aggregates, evaluation, windows
from corpusloom.plans.registry import query
from corpusloom.sources.readers import table

#: Both rules' runs, in DuckDB. A row each of a sample and a system.
_RUNS = r"""
with base as (
  select l.doc_id, d.source, case when l.toxic = 1 then 'high' when l.quality = 0 then 'medium' else 'safe' end as gold, d.n_chars, l.doc_id % 7 as m, l.doc_id % 11 as v
  from labels l join documents d on l.doc_id = d.doc_id),
runs as (
  select doc_id, source, gold, 'baseline' as system, case when m = 0 then null when n_chars > 3000 then 'high' when n_chars < 900 then 'medium' else 'safe' end as predicted,
    m <> 0 as success, n_chars % 13 / 4.0 as seconds, n_chars % 5 as opinions, n_chars % 4 as citations, n_chars % 2 as verified from base
  union all
  select doc_id, source, gold, 'system', case when v = 0 then null when n_chars > 2000 and m < 4 then 'high' when m = 5 then 'medium' else gold end,
    v <> 0, n_chars % 17 / 4.0, n_chars % 6, n_chars % 5, n_chars % 3 from base)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    gold = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("safe")
    base = labels.join(docs, "doc_id").select("doc_id", "source", gold.alias("gold"), "n_chars", (F.col("doc_id") % 7).alias("m"), (F.col("doc_id") % 11).alias("v"))
    n = F.col("n_chars")
    first = F.when(F.col("m") == 0, None).when(n > 3000, "high").when(n < 900, "medium").otherwise("safe")
    second = F.when(F.col("v") == 0, None).when((n > 2000) & (F.col("m") < 4), "high").when(F.col("m") == 5, "medium").otherwise(F.col("gold"))
    row = lambda name, label, ok, a, b, c, d: F.struct(F.lit(name).alias("system"), label.alias("predicted"), ok.alias("success"), (n % a / 4.0).alias("seconds"), (n % b).alias("opinions"), (n % c).alias("citations"), (n % d).alias("verified"))
    both = F.array(row("baseline", first, F.col("m") != 0, 13, 5, 4, 2), row("system", second, F.col("v") != 0, 17, 6, 5, 3))
    return base.select("doc_id", "source", "gold", F.explode(both).alias("r")).select("doc_id", "source", "gold", "r.*")


def _system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).filter("system = 'system'")


@query(_RUNS + """, ok as (select * from runs where system = 'system' and success and predicted is not null), dims(gold) as (values ('safe'), ('medium'), ('high'))
select d.gold, count(*) filter (predicted = 'safe') as pred_safe, count(*) filter (predicted = 'medium') as pred_medium, count(*) filter (predicted = 'high') as pred_high
from dims d left join ok on ok.gold = d.gold group by d.gold""")
def eval_confusion(spark, sf_dir):
    """Zero-filled confusion matrix (A1)."""
    return evaluation.confusion(_system(spark, sf_dir))


_LABELS = _RUNS + """, ok as (select * from runs where system = 'system' and success and predicted is not null), dims(label) as (values ('safe'), ('medium'), ('high')),
counts as (select label, count(*) filter (gold = label and predicted = label) as tp, count(*) filter (gold <> label and predicted = label) as fp, count(*) filter (gold = label and predicted <> label) as fn from dims, ok group by label),
pr as (select label, tp + fn as support, case when tp + fp = 0 then 0.0 else round(tp::double / (tp + fp), 6) end as precision, case when tp + fn = 0 then 0.0 else round(tp::double / (tp + fn), 6) end as recall from counts),
f as (select *, case when precision + recall = 0 then 0.0 else round(2 * precision * recall / (precision + recall), 6) end as f1 from pr)
"""


@query(_LABELS + "select label, precision, recall, f1, support from f")
def eval_per_label(spark, sf_dir):
    """Precision, recall, F1 and support of each label (A2)."""
    return evaluation.per_label(_system(spark, sf_dir))


@query(_LABELS + "select round(sum(f1) / 3, 6) as macro_f1 from f")
def eval_macro_f1(spark, sf_dir):
    """Macro F1 (A3)."""
    return evaluation.macro_f1(_system(spark, sf_dir))


_RATES = _RUNS + """, ok as (select *, success and predicted is not null as ok, list_position(['safe', 'medium', 'high'], predicted) < list_position(['safe', 'medium', 'high'], gold) as under from runs),
c as (select system, count(*) as total, count(*) filter (ok) as valid, count(*) filter (not success) as failed, count(*) filter (ok and gold = predicted) as hit,
  count(*) filter (ok and gold = 'safe') as safes, count(*) filter (ok and gold = 'high') as highs, count(*) filter (ok and gold = 'high' and predicted <> 'high') as missed,
  count(*) filter (ok and gold = 'high' and predicted = 'safe') as tosafe, count(*) filter (ok and under) as under,
  count(*) filter (ok and gold <> 'safe' and predicted <> 'safe') as tp, count(*) filter (ok and gold = 'safe' and predicted <> 'safe') as fp,
  count(*) filter (ok and gold <> 'safe' and predicted = 'safe') as fn, count(*) filter (ok and gold = 'safe' and predicted = 'safe') as tn from ok group by system),
r as (select system, total, valid, failed, round(coalesce(hit::double / nullif(valid, 0), 0), 6) as accuracy, round(coalesce(fp::double / nullif(safes, 0), 0), 6) as safe_false_positive_rate,
  round(coalesce(under::double / nullif(valid, 0), 0), 6) as severe_underestimate_rate, round(coalesce(missed::double / nullif(highs, 0), 0), 6) as high_miss_rate,
  case when highs = 0 then 0.0 else round(1.0 - round(missed::double / highs, 6), 6) end as high_recall, round(coalesce(tosafe::double / nullif(highs, 0), 0), 6) as high_to_safe_rate,
  round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as risk_precision, round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as risk_recall,
  round(coalesce((tp + tn)::double / nullif(valid, 0), 0), 6) as risk_accuracy, round(failed::double / total, 6) as failure_rate from c),
m as (select *, round(coalesce(2 * risk_precision * risk_recall / nullif(risk_precision + risk_recall, 0), 0), 6) as risk_f1 from r)
"""


@query(_RATES + "select * from m")
def eval_rates(spark, sf_dir):
    """All rates of both systems in one aggregation (A3-A5)."""
    return evaluation.rates(runs(spark, sf_dir), ["system"])


@query(_RATES + """, long as (
  unpivot (select system, risk_accuracy, risk_precision, risk_recall, risk_f1, high_recall, high_miss_rate from m) on risk_accuracy, risk_precision, risk_recall, risk_f1, high_recall, high_miss_rate into name metric value v)
select metric, max(v) filter (system = 'baseline') as first, max(v) filter (system = 'system') as second, round(max(v) filter (system = 'system') - max(v) filter (system = 'baseline'), 6) as delta from long group by metric""")
def eval_delta(spark, sf_dir):
    """Change of each metric between two systems."""
    return evaluation.delta(evaluation.rates(runs(spark, sf_dir), ["system"]), "system", "baseline", "system", ["risk_accuracy", "risk_precision", "risk_recall", "risk_f1", "high_recall", "high_miss_rate"])


@query(_RUNS + """select round(count(*) filter (not success)::double / count(*), 6) as failure_rate, round(sum(seconds) filter (success) / count(*) filter (success), 6) as avg_seconds,
round(sum(opinions) filter (success)::double / count(*) filter (success), 6) as avg_opinions, round(sum(verified) filter (success)::double / sum(citations) filter (success), 6) as verified_ratio from runs where system = 'system'""")
def eval_engineering(spark, sf_dir):
    """Failure rate, mean latency and verified share."""
    return evaluation.engineering(_system(spark, sf_dir))


@query(_RUNS + """, p as (select doc_id, gold, max(predicted) filter (system = 'baseline') as first, max(predicted) filter (system = 'system') as second from runs group by doc_id, gold)
select doc_id, gold, first, second, case when first is distinct from gold and second is not distinct from gold then 'improved' when first is not distinct from gold and second is distinct from gold then 'regressed'
  when first is not distinct from gold then 'same_correct' else 'same_wrong' end as category, gold = 'safe' and second is distinct from gold as false_alarm, gold = 'high' and second is distinct from gold as missed from p""")
def eval_paired(spark, sf_dir):
    """Paired comparison of two systems; a failed run counts as a miss."""
    r = runs(spark, sf_dir)
    return evaluation.paired(r.select("doc_id", "gold").distinct(), r.filter("system = 'baseline'"), r.filter("system = 'system'"), "doc_id")


@query(_RUNS + """, dims(level) as (values ('none'), ('safe'), ('medium'), ('high'), ('fatal')), s as (select * from runs where system = 'system')
select level, (select count(*) from s where predicted = level) as n, (select count(*) from s where predicted <> 'none') as risky from dims""")
def eval_distribution(spark, sf_dir):
    """Zero-filled distribution over levels and count of risky rows."""
    return evaluation.distribution(_system(spark, sf_dir), "predicted", ["none", "safe", "medium", "high", "fatal"], "none")


@query(_RUNS + """select doc_id, gold, predicted, success from runs where system = 'system' and (not success or list_position(['safe', 'medium', 'high'], predicted) < list_position(['safe', 'medium', 'high'], gold))""")
def eval_failures(spark, sf_dir):
    """Failed and underestimated rows."""
    return evaluation.failures(_system(spark, sf_dir)).select("doc_id", "gold", "predicted", "success")


@query(_RUNS + """, s as (select doc_id, gold, row_number() over (partition by gold order by md5(doc_id::varchar || '42'), doc_id) as nth from runs where system = 'system')
select doc_id, gold, nth from s where nth <= case gold when 'safe' then 34 when 'medium' then 33 else 33 end""")
def eval_stratified_sample(spark, sf_dir):
    """A seeded sample of 100, in equal parts by label."""
    return windows.stratified(_system(spark, sf_dir), "gold", ["safe", "medium", "high"], 100, "doc_id", "42").select("doc_id", "gold", "nth")


@query(_RUNS + """, chosen as (select source, count(*) as n from runs where system = 'system' and gold = 'high' group by source)
select s.source, coalesce(n, 0) as n from (select distinct source from documents) s left join chosen c on c.source = s.source where coalesce(n, 0) < 3""")
def eval_gaps(spark, sf_dir):
    """Sources with fewer than three chosen rows."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    return aggregates.gaps(sources, _system(spark, sf_dir).filter("gold = 'high'"), "source", 3)


@query("""with t as (select conv_id, role from conversations where role <> 'system')
select role as name, count(*) as n from t group by role""")
def trace_tools(spark, sf_dir):
    """Calls by name over traces."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.filter(F.collect_list("role"), lambda r: r != "system").alias("calls"))
    return aggregates.trace_counts(c, "conv_id", "calls")[0]


@query("""select count(distinct conv_id) as traces, round(count(*) filter (role <> 'system')::double / count(distinct conv_id), 6) as calls_per_trace from conversations""")
def trace_means(spark, sf_dir):
    """Calls per trace."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.filter(F.collect_list("role"), lambda r: r != "system").alias("calls"))
    return aggregates.trace_counts(c, "conv_id", "calls")[1]


@query(_RATES + "select system, metric, value from (unpivot (select system, columns(* exclude (system))::double from m) on columns(* exclude (system)) into name metric value value)")
def eval_report(spark, sf_dir):
    """All rates of both systems as rows, for a metrics file."""
    return evaluation.report(runs(spark, sf_dir), "system")
