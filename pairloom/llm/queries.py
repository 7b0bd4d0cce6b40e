"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import defects, leaks, packing, quantiles, ranking, similar, spans, truncation
from pairloom.session import read, spread


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(quantiles.daily(spread(read(spark, sf_dir, "results", quantiles.ANSWERS))))


def p1_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = quantiles.daily(spread(read(spark, sf_dir, "results", quantiles.ANSWERS)))
    return quantiles.quantiles(days, ["model_name", "capability", "metric", "day"], quantiles.PERCENTILES)


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = read(spark, sf_dir, "model_catalog").selectExpr("model_name as item")
    met = ranking.matches(read(spark, sf_dir, "results", ranking.VERDICTS), read(spark, sf_dir, "bench_runs"))
    return ranking.ranking(met, catalog).withColumnRenamed("item", "model_name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar.near_pairs(spread(read(spark, sf_dir, "test_cases")))
    return found.select(found.rid_a.alias("case_key_a"), found.rid_b.alias("case_key_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.near_groups(spread(read(spark, sf_dir, "test_cases")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.defects(spread(read(spark, sf_dir, "results", defects.RESULTS)), spread(read(spark, sf_dir, "test_cases")))


def p3_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers per model and kind."""
    return p3_found(spark, sf_dir).groupBy("model_name", "defect").count().withColumnRenamed("count", "n")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(spread(read(spark, sf_dir, "results", truncation.RESPONSES)))


def p4_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.report(spread(read(spark, sf_dir, "results", truncation.RESPONSES)))


def p4_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = truncation.hazards(truncation.lengths(spread(read(spark, sf_dir, "results", truncation.RESPONSES))))
    return found.withColumns({c: F.round(c, 9) for c in ("hazard", "expected", "log_p")})


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(read(spark, sf_dir, "documents")))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.pack(spread(read(spark, sf_dir, "documents"))))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.mixture(spread(read(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(p8_found(spark, sf_dir), read(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(spread(read(spark, sf_dir, "documents")))


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(spread(read(spark, sf_dir, "documents")))


QUERIES = {"p1_percentiles": p1_percentiles, "p1_daily": p1_daily, "p5_ranking": p5_ranking, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_models": p3_models, "p4_found": p4_found, "p4_models": p4_models, "p4_hazards": p4_hazards, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_mixture": p7_mixture, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_share": p9_share}


def _folded(column: str) -> tuple[str, str]:
    """Compatibility folding, composition and removal of invisible characters in SQL; the folding of each character by the same
    rule as in Python."""
    table = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(128, 0x30000) if not 0xD800 <= c <= 0xDFFF and not 0xAC00 <= c <= 0xD7A3}  # beyond it nothing is folded
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in table.items() if k != v and "'" not in v)
    hidden = r"[\p{Cf}\x{34F}\x{FE00}-\x{FE0F}]"
    shown = f"regexp_replace({column}, '{hidden}', '', 'g')"
    mapped = f"array_to_string(list_transform(string_split({shown}, ''), lambda c: case when ascii(c) < 128 then c else coalesce(m[c], c) end), '')"
    return f"case when regexp_matches({column}, '[^\\x00-\\x7F]') then regexp_replace(nfc_normalize({mapped}), '{hidden}', '', 'g') else {column} end", f"folding as (select map {{{pairs}}} as m)"


def _leaked() -> str:
    folded, table = _folded("text")
    runs = "select {id}, array_to_string(w[i:i + 11], ' ') as run from (select {id}, w, unnest(range(1, len(w) - 10)) as i from (select {id}, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') as w from (select {id}, " + folded.replace("{", "{{").replace("}", "}}") + " as t from {table}, folding where text is not null)))"
    return f"with {table}, d as ({runs.format(id='doc_id', table='documents')}), e as ({runs.format(id='item_id', table='eval_items')}), f as (select distinct doc_id, item_id from d join e using (run))"


_ONCE = "once as (select * from (select *, row_number() over (partition by result_id order by received_at) as rn from results) where rn = 1)"
_MEASURES = (
    f"with {_ONCE}, e as (select capability, cast(finished_at as date) as day, unnest(map_keys(responses)) as model_name, unnest(map_values(responses)) as a from once), "
    "v as (select model_name, capability, day, 'latency_ms' as metric, a.latency_ms as value from e union all select model_name, capability, day, 'tokens', cast(a.tokens as double) from e)"
)
_READ = "count(*) as n, " + ", ".join(f"quantile_disc(value, {q}) as p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + ", cast(0 as bigint) as rank_error from v where value > 0 group by all"

#: For the percentiles: exact where no group has more values than a sketch keeps whole, as at sf0.01.
SQL = {
    "p1_percentiles": f"{_MEASURES} select 'whole' as level, model_name, capability, metric, null::date as day, {_READ} union all select 'day', model_name, capability, metric, day, {_READ}",
    "p4_hazards": f"""
        with {_ONCE}, e as (select unnest(map_keys(responses)) as source, unnest(map_values(responses)).response as t from once),
        l as (select source, 'chars' as measure, length(t)::int as length from e union all select source, 'bytes', strlen(t)::int from e),
        c as (select source, measure, length, count(*) as n from l where length > 0 group by all),
        w as (select *, cast(sum(n) over (partition by source, measure order by length rows between current row and unbounded following) as bigint) as at_risk,
          greatest(coalesce(sum(n) over (partition by source, measure order by length range between 16 preceding and 1 preceding), 0) / 16.0::double, coalesce(sum(n) over (partition by source, measure order by length range between 1 following and 16 following), 0) / 16.0::double, 0.0625::double) as expected from c),
        p as (select *, n::double / at_risk as hazard, case when n > expected then n - expected - n * ln(n / expected) else 0.0::double end as log_p from w),
        k as (select *, row_number() over (partition by source order by log_p, measure, length) as k, count(*) over (partition by source) as m from p),
        s as (select *, coalesce(max(case when log_p <= ln(k * 0.001::double / m) then k end) over (partition by source), 0) as last from k)
        select source, measure, length, n, at_risk, round(hazard, 9) as hazard, round(expected, 9) as expected, round(log_p, 9) as log_p, k <= last as significant from s""",
    "p1_daily": f"{_MEASURES} select model_name, capability, metric, day, {_READ}",
    "p2_found": """
        with t as (select case_key, unnest(turns) as turn from test_cases),
        w as (select case_key, regexp_extract_all(lower(turn), '[\\p{L}\\p{N}]+') as w from t where turn is not null),
        p as (select distinct case_key, w[i] || ' ' || w[i + 1] as pair from (select case_key, w, unnest(range(1, len(w))) as i from w)),
        n as (select case_key, count(*) as n from p group by 1 having count(*) >= 10),
        b as (select x.case_key as a, y.case_key as b, count(*) as c from p x join p y on x.pair = y.pair and x.case_key < y.case_key group by all)
        select a as case_key_a, b as case_key_b from b join n na on na.case_key = a join n nb on nb.case_key = b where c >= 0.6 * (na.n + nb.n - c) - 1e-9""",
    "p9_found": """
        with w as (select distinct doc_id, md5(substr(text, i, 360)) as h from (select doc_id, text, unnest(range(1, length(text) - 358)) as i from documents where length(text) >= 360)),
        s as (select h from w group by h having count(*) > 1), k as (select doc_id, h from w semi join s using (h))
        select distinct x.doc_id as doc_id_a, y.doc_id as doc_id_b from k x join k y on x.h = y.h and x.doc_id < y.doc_id""",
    "p8_found": f"{_leaked()} select doc_id, item_id from f",
    "p8_items": f"{_leaked()} select item_id, category, coalesce(n_docs, 0) as n_docs, first_doc_id from eval_items left join (select item_id, count(*) as n_docs, min(doc_id) as first_doc_id from f group by 1) using (item_id)",
    "p9_share": """
        with d as (select doc_id, text, length(text) as n_chars, min(doc_id) over (partition by text) as rep from documents where length(text) >= 360),
        w as (select doc_id, n_chars, rep, i, md5(substr(text, i, 360)) as h from (select *, unnest(range(1, n_chars - 358)) as i from d)),
        k as (select * from w semi join (select h from w group by h having count(distinct doc_id) > 1) s using (h)),
        c as (select doc_id, n_chars, rep, least(360, coalesce(lead(i) over (partition by doc_id order by i) - i, 360)) as n from k)
        select doc_id, rep, n_chars, cast(sum(n) as bigint) as n_shared, round(sum(n)::double / n_chars, 6) as share from c group by doc_id, rep, n_chars""",
    # near pairs as p2_found, with equal sets; groups by following links to the least key until nothing changes
    "p2_groups": """
        with recursive t as (select case_key, unnest(turns) as turn from test_cases),
        w as (select case_key, regexp_extract_all(lower(turn), '[\\p{L}\\p{N}]+') as w from t where turn is not null),
        p as (select distinct case_key, w[i] || ' ' || w[i + 1] as pair from (select case_key, w, unnest(range(1, len(w))) as i from w)),
        n as (select case_key, count(*) as n from p group by 1 having count(*) >= 10),
        b as (select x.case_key as a, y.case_key as b, count(*) as c from p x join p y on x.pair = y.pair and x.case_key < y.case_key group by all),
        f as materialized (select a, b from b join n na on na.case_key = a join n nb on nb.case_key = b where c >= 0.6 * (na.n + nb.n - c) - 1e-9),
        l as (select a, b from f union all select b, a from f),
        r as (select a, a as g from l union select l.b, r.g from r join l on l.a = r.a)
        select r.a as case_key, min(g) as group_key, any_value(k.links) as links from r join (select a, count(*) as links from l group by 1) k on k.a = r.a group by r.a""",
    # Jacobi iteration with the mean taken off, which converges where all models are connected
    "p5_ranking": """
        with recursive once as (select * from (select *, row_number() over (partition by result_id order by received_at) as rn from results) where rn = 1),
        runs as (select benchmark_id, coalesce(nullif(models[1].alias, ''), models[1].provider || '/' || models[1].model) as a, coalesce(nullif(models[2].alias, ''), models[2].provider || '/' || models[2].model) as b from bench_runs),
        m as (select a, b, winner from once join runs using (benchmark_id) where winner is not null),
        one as (select a as i, b as j, case winner when 'A' then 1.0 when 'B' then 0.0 else 0.5 end as w, winner = 'A' as won, winner = 'B' as lost from m
          union all select b, a, case winner when 'B' then 1.0 when 'A' then 0.0 else 0.5 end, winner = 'B', winner = 'A' from m),
        e as (select i, j, count(*)::double as w from one group by all),
        d as (select i, count(*) + 0.1 as d, sum(w - (1 - w))::double as b, count(*) filter (won) as wins, count(*) filter (lost) as losses, count(*) filter (not won and not lost) as ties from one group by 1),
        it as (select 0 as k, i as item, 0.0::double as s from d
          union all select k + 1, item, s - avg(s) over () from (select it.k, d.i as item, (d.b + sum(e.w * it.s)) / d.d as s from it join e on e.j = it.item join d on d.i = e.i where it.k < 150 group by it.k, d.i, d.b, d.d)),
        f as (select c.model_name, coalesce(round(it.s, 6), 0.0) + 0.0 as strength, coalesce(wins, 0) as wins, coalesce(losses, 0) as losses, coalesce(ties, 0) as ties from (select model_name from model_catalog union select i from d) c left join it on it.item = c.model_name and it.k = 150 left join d on d.i = c.model_name)
        select model_name, strength, rank() over (order by strength desc) as rank, wins, losses, ties from f""",
}
