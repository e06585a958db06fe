"""Registered KPI queries."""

from __future__ import annotations

from datetime import datetime

from radiokpi.functions import safe_ratio
from radiokpi.operators import kpi_definitions as d, kpi_ratio as r, kpi_results as k, kpi_semantic as s
from radiokpi.plans.query import PLACES, Query
from radiokpi.schemas import ITBBU_CELL, ITBBU_PLATFORM, SDR_CELL

_FROM, _TO = datetime(2026, 3, 1, 6), datetime(2026, 3, 2, 18)
_REF = "counter_id, vendor, technology, object_type, description, unit, source_type, source_reference, verification_status, verified_at, notes"
_IND = "indicator_code, indicator_name, semantic_alias, aggregation_method, unit, verification_status, source, lineage_expression, lineage_type, raw_counter_dependencies"
_ALIASES = ["part_1", "part_7", "part_30"]
_KPI = "kpi_name, technology, description, unit, aggregation_grain_notes, formula_notes"
_RRC = "rrc_connected_users_max rrc_connected_users_mean rrc_connected_users_online"
_RRC_PLACE = ("max(rrc_connected_users_max) as rrc_connected_users_max, avg(rrc_connected_users_mean) as rrc_connected_users_mean, "
              "sum(rrc_connected_users_online) as rrc_connected_users_online")
_RATIO = {"prb": ("dl_prb_utilization", "ul_prb_utilization"), "bler": ("dl_bler", "ul_bler")}
_PARTS = {"dl_prb_utilization": ("dl_prb_used", "dl_prb_available"), "ul_prb_utilization": ("ul_prb_used", "ul_prb_available"),
          "dl_bler": ("dl_tb_error_blocks", "dl_tb_total_blocks"), "ul_bler": ("ul_tb_error_blocks", "ul_tb_total_blocks")}
_WEIGHTED = """
    (select m.kpi_name, counter_role, weight, s.* from kpi_counter_mapping m
     join kpi_definition d on d.kpi_name = m.kpi_name and d.status = 'ACTIVE' and d.formula_type = 'ratio'
     join counter_reference c on c.counter_id = m.counter_id and c.verification_status = 'VERIFIED'
     join pm_sample s on s.counter_id = m.counter_id)"""
_DETAILS = """
    select kpi_name, technology, any_value(k.description) as description, formula_type, scale_factor, formula_notes, k.unit,
      aggregation_grain_notes, status, pending_reason,
      ifnull(string_agg(m.counter_id, ',' order by m.counter_id) filter (counter_role = 'numerator'), '') as numerator_counter_ids,
      ifnull(string_agg(m.counter_id, ',' order by m.counter_id) filter (counter_role = 'denominator'), '') as denominator_counter_ids,
      ifnull(string_agg(m.counter_id, ',' order by m.counter_id) filter (verification_status is distinct from 'VERIFIED'), '') as unverified_counter_ids,
      count(m.counter_id) > 0 and count(m.counter_id) = count(*) filter (verification_status = 'VERIFIED') as all_mapped_counters_verified
    from kpi_definition k left join kpi_counter_mapping m using (kpi_name)
    left join (select counter_id, verification_status from counter_reference) c on c.counter_id = m.counter_id group by all"""
_SEMANTIC = """
    select f.kpi_code, f.kpi_name, formula_expression, grain, f.unit, f.verification_status, topology_rollup_allowed, f.notes,
      count(i.input_alias) as input_count, ifnull(string_agg(distinct i.input_alias, ',' order by i.input_alias), '') as input_aliases,
      ifnull(string_agg(distinct i.counter_alias, ',' order by i.counter_alias), '') as counter_aliases,
      ifnull(string_agg(distinct i.counter_alias, ',' order by i.counter_alias)
        filter (d.verification_status is distinct from 'VERIFIED'), '') as unverified_counter_aliases
    from kpi_formula f left join kpi_formula_input i using (kpi_code)
    left join counter_dictionary d on d.dataset_family = i.dataset_family and d.counter_alias = i.counter_alias group by all"""


def _ratio_by(grain: str, columns: str, named: str = "") -> str:
    return f"""
        select {', '.join('k.' + c for c in _KPI.split(', '))}, {columns}, n as numerator_value, d as denominator_value,
          n / nullif(d, 0) * ifnull(k.scale_factor, 1) as kpi_value
        from (select kpi_name, {grain}, sum(counter_value * weight) filter (counter_role = 'numerator') as n,
            sum(counter_value * weight) filter (counter_role = 'denominator') as d
          from {_WEIGHTED} group by kpi_name, {grain}
          having count(*) filter (counter_role = 'numerator') > 0 and count(*) filter (counter_role = 'denominator') > 0) v
        join kpi_definition k using (kpi_name) {named}"""


def _place_time(family: str, place: str, code_as: str | None = None) -> str:
    values = ", ".join(f"avg(kpi_value) filter (kpi_code = '{c}') as {c}" for c in _RATIO[family])
    return f"""select dataset_family, {place}_code as {code_as or place}, collect_time, {values} from ratio_entity
        where dataset_family like '%/ltefdd' and {place}_code is not null and kpi_code in {_RATIO[family]} group by all"""


def _validation(rows: str, label: str, values: tuple) -> str:
    counts = ", ".join(f"count({v}) as rows_with_{v}" for v in values)
    return f"select dataset_family, count(*) as {label}, {counts} from ({rows}) where dataset_family like '%/ltefdd' group by all"


def _execution(family: str) -> str:
    return f"""
        with c as (select kpi_code, dataset_family, count(distinct input_alias) as covered_input_aliases,
            min(counter_verification_status) as min_counter_verification_status, min(distinct_collect_times) as min_input_collect_times,
            min(distinct_logical_entities) as min_input_entities from input_coverage where kpi_code in {_RATIO[family]} group by all),
          e as (select kpi_code, dataset_family, count(*) as executed_rows, count(distinct collect_time) as executed_collect_times,
            count(distinct logical_entity_key) as executed_entities from ratio_entity group by all)
        select c.*, ifnull(executed_rows, 0) as executed_rows, ifnull(executed_collect_times, 0) as executed_collect_times,
          ifnull(executed_entities, 0) as executed_entities from c left join e using (kpi_code, dataset_family)"""


def _sums(aliases, dataset_family: str, window: str) -> str:
    """Entity sums per alias over the counters the dictionary verifies."""
    sums = ", ".join(f"sum(counter_value) filter (counter_alias = '{a}') as {a}" for a in aliases)
    return f"""select dataset_family, logical_entity_key, collect_time, {sums}
        from keyed join (select counter_id, counter_alias from counter_dictionary
          where dataset_family = '{dataset_family}' and verification_status = 'VERIFIED') using (counter_id)
        where dataset_family = '{dataset_family}' and {window} group by all"""


def _fast_entity(family: str, dataset_family: str, window: str) -> str:
    a, b = (_PARTS[c] for c in _RATIO[family])
    metrics = ", ".join(f"100 * {_PARTS[c][0]} / nullif({_PARTS[c][1]}, 0) as {c}" for c in _RATIO[family])
    return f"select *, {metrics} from ({_sums([*a, *b], dataset_family, window)}) where {a[1]} is not null or {b[1]} is not null"


def _newest(dataset_family: str) -> str:
    return f"collect_time = (select max(collect_time) from pm_wide where dataset_family = '{dataset_family}')"


_RANGE = "collect_time between cast('2026-03-01 06:00' as timestamp) and cast('2026-03-02 18:00' as timestamp)"


def _entity_rows(family: str, dataset_family: str, window: str) -> str:
    return f"""select f.dataset_family, f.logical_entity_key, collect_time, ifnull(i.entity_level, {'own'}) as entity_level, site_code, region_code,
          {', '.join(_RATIO[family])}
        from (select *, case when dataset_family like '%/ltefdd' then 'cell' else 'meid' end as own from ({_fast_entity(family, dataset_family, window)})) f
        left join entity_identity i using (logical_entity_key)
        left join (select logical_entity_key, site_code, region_code from topo_enrichment) t using (logical_entity_key)"""


def _rollup_rows(family: str, place: str, dataset_family: str, window: str, where: str = "true") -> str:
    return f"""select f.dataset_family, {place}_code, {place}_name, collect_time, {', '.join(f'avg({c}) as {c}' for c in _RATIO[family])}
        from ({_fast_entity(family, dataset_family, window)}) f join topo_enrichment t using (logical_entity_key)
        where {place}_code is not null and {where} group by all"""


_RRC_RESULT = f"""
    select f.dataset_family, f.logical_entity_key, collect_time, ifnull(i.entity_level, 'cell') as entity_level, site_code, region_code,
      rrc_connected_users_max, rrc_connected_users_mean, rrc_connected_users_online
    from (select dataset_family, logical_entity_key, collect_time,
        max(counter_value) filter (counter_alias = 'max_rrc_connected_users') as rrc_connected_users_max,
        avg(counter_value) filter (counter_alias = 'mean_rrc_connected_users') as rrc_connected_users_mean,
        sum(counter_value) filter (counter_alias = 'online_rrc_connected_users') as rrc_connected_users_online
      from keyed join (select counter_id, counter_alias from counter_dictionary
          where dataset_family = '{SDR_CELL}' and verification_status = 'VERIFIED' and counter_alias like '%rrc_connected_users')
        using (counter_id) where dataset_family = '{SDR_CELL}' and {_newest(SDR_CELL)} group by all) f
    left join entity_identity i using (logical_entity_key)
    left join (select logical_entity_key, site_code, region_code from topo_enrichment) t using (logical_entity_key)"""


def _fast_validation(family: str, only: str = "true") -> str:
    tuple_of = ("case k.dataset_family when 'PM/sdr/ltefdd' then row(sbnid, enodebid, cellid, null, null, null) "
                "when 'PM/itbbu/ltefdd' then row(sbnid, enbid, cellid, null, null, null) "
                "else row(sbnid, enbid, enodebid, cellid, meid, ani) end")
    return f"""
        with spec as (select i.kpi_code, i.dataset_family, i.input_alias, d.counter_id, d.verification_status as status
            from kpi_formula f join kpi_formula_input i on i.kpi_code = f.kpi_code and i.required
            join counter_dictionary d on d.dataset_family = i.dataset_family and d.counter_alias = i.counter_alias
            where f.verification_status = 'VERIFIED' and f.kpi_code in {_RATIO[family]} and {only}),
          seen as (select p.kpi_code, p.dataset_family, p.input_alias, k.collect_time, {tuple_of} as entity
            from pm_sample k join spec p on p.dataset_family = k.dataset_family and p.counter_id = k.counter_id),
          cover as (select kpi_code, dataset_family, input_alias, count(distinct collect_time) as t, count(distinct entity) as n from seen group by all),
          need as (select kpi_code, dataset_family, count(c.input_alias) as covered_input_aliases, min(status) as min_counter_verification_status,
            min(t) as min_input_collect_times, min(n) as min_input_entities, count(distinct s.input_alias) as required
            from spec s left join cover c using (kpi_code, dataset_family, input_alias) group by all),
          full_rows as (select kpi_code, dataset_family, collect_time, entity, count(distinct input_alias) as present from seen group by all),
          ran as (select f.kpi_code, f.dataset_family, count(*) as executed_rows, count(distinct collect_time) as executed_collect_times,
            count(distinct entity) as executed_entities from full_rows f join need using (kpi_code, dataset_family)
            where present = required group by all)
        select need.* exclude (required), ifnull(executed_rows, 0) as executed_rows, ifnull(executed_collect_times, 0) as executed_collect_times,
          ifnull(executed_entities, 0) as executed_entities from need left join ran using (kpi_code, dataset_family)"""


QUERIES = [
    # --- definitions
    Query("counter_list", lambda t: d.counter_list(t, limit=500), f"select {_REF} from counter_reference order by counter_id limit 500"),
    Query("counter_by_id", lambda t: d.counter_by_id(t, counter_id="C373200004"),
          f"select {_REF} from counter_reference where counter_id = 'C373200004'"),
    Query("kpi_definition_details", d.kpi_definition_details, _DETAILS, "scale_factor"),
    Query("kpi_definition", lambda t: d.kpi_definition(t, kpi_name="lte_bler"), f"select * from ({_DETAILS}) where kpi_name = 'lte_bler'", "scale_factor"),
    Query("kpi_list", lambda t: d.kpi_definition_details(t, limit=50), f"{_DETAILS} order by kpi_name limit 50", "scale_factor"),
    Query("semantic_kpi_definition_details", d.semantic_kpi_definition_details, _SEMANTIC),
    Query("provisional_kpis", d.provisional_kpis, f"""
        select * from ({_SEMANTIC}) where verification_status <> 'VERIFIED' or unverified_counter_aliases <> '' or input_count = 0"""),
    Query("verified_counter_specs", lambda t: d.verified_counter_specs(
        t, dataset_family=SDR_CELL, aliases=["ul_tb_total_blocks", "ul_tb_error_blocks", "part_1", "part_2"]), f"""
        select counter_id, counter_alias from counter_dictionary where dataset_family = '{SDR_CELL}' and verification_status = 'VERIFIED'
          and counter_alias in ('ul_tb_total_blocks', 'ul_tb_error_blocks', 'part_1', 'part_2')"""),
    Query("vendor_indicator_details", d.vendor_indicator_details,
          f"select {_IND} from vendor_indicator left join vendor_lineage using (indicator_code)"),
    Query("vendor_indicators", lambda t: d.vendor_indicator_details(t, limit=100),
          f"select {_IND} from vendor_indicator left join vendor_lineage using (indicator_code) order by indicator_code limit 100"),
    Query("vendor_indicators_by_alias", lambda t: d.vendor_indicators_by_alias(t, aliases=_ALIASES), f"""
        select {_IND} from vendor_indicator left join vendor_lineage using (indicator_code) where semantic_alias in {tuple(_ALIASES)}"""),

    # --- weighted ratios
    Query("kpi_ratio_values_by_time", r.kpi_ratio_values_by_time, _ratio_by("collect_time", "collect_time"),
          "numerator_value denominator_value kpi_value"),
    Query("kpi_ratio_values_by_time_ani", r.kpi_ratio_values_by_time_ani,
          _ratio_by("collect_time, ani", "collect_time, v.ani, logical_entity_key, site_code, region_name",
                    "left join ani_entity a on a.ani = v.ani"), "numerator_value denominator_value kpi_value"),
    Query("summarize_kpi", lambda t: r.summarize_kpi(t, kpi_name="lte_prb_utilization", limit=100), f"""
        select * from ({_ratio_by("collect_time, ani", "collect_time, v.ani, logical_entity_key, site_code, region_name",
                                  "left join ani_entity a on a.ani = v.ani")}) where kpi_name = 'lte_prb_utilization'
        order by collect_time desc, ani nulls last limit 100""", "numerator_value denominator_value kpi_value"),
    Query("safe_ratio", lambda t: t.pm_wide.select("source_file", "csv_name", "collect_time", "ani", safe_ratio(
        "C373424610", "C373424609", 100.0).alias("ratio"), safe_ratio("C373424608", "C373424611").alias("unscaled")), """
        select source_file, csv_name, collect_time, ani, C373424610 / nullif(C373424609, 0) * 100 as ratio,
          C373424608 / nullif(C373424611, 0) as unscaled from pm_wide""", "ratio unscaled"),

    # --- semantic layer
    Query("raw_with_counter_semantics", s.raw_with_counter_semantics, f"""
        select source_file, p.dataset_family, interval_start, collect_time, logical_entity_key, p.entity_level, {PLACES}, p.counter_id,
          counter_value, counter_alias, counter_name, d.unit, aggregation_behavior, verification_status as counter_verification_status,
          source_note from placed p left join counter_dictionary d on d.dataset_family = p.dataset_family and d.counter_id = p.counter_id""",
          "counter_value"),
    Query("semantic_kpi_base_inputs", s.base_inputs, "select * from base_inputs",
          "sum_counter_value avg_counter_value min_counter_value max_counter_value"),
    Query("semantic_kpi_input_coverage", s.kpi_input_coverage, "select * from input_coverage"),
    *[Query(f"verified_{f}_entity_time", lambda t, f=f: s.verified_entity_time(t, family=f),
            f"select * from ratio_entity where kpi_code in {_RATIO[f]}", "numerator_value denominator_value kpi_value") for f in _RATIO],
    Query("verified_rrc_entity_time", s.verified_rrc_entity_time, "select * from rrc_entity", _RRC),
    *[Query(f"{f}_{p}_time", lambda t, f=f, p=p: s.verified_place_time(t, family=f, place=p), _place_time(f, p), " ".join(_RATIO[f]))
      for f in _RATIO for p in ("site", "region")],
    Query("rrc_topology_join", s.rrc_topology_join, "select * from rrc_placed", _RRC),
    *[Query(f"rrc_{p}_time", lambda t, p=p: s.verified_rrc_place_time(t, place=p), f"""
        select dataset_family, {p}_code as {p}, collect_time, {_RRC_PLACE} from rrc_placed where {p}_code is not null group by all""", _RRC)
      for p in ("site", "region")],
    *[Query(f"{f}_execution_validation", lambda t, f=f: s.execution_validation(t, family=f), _execution(f)) for f in _RATIO],
    Query("rrc_entity_validation", lambda t: s.output_validation(t, family="rrc", grain="entity"),
          _validation("select * from rrc_entity", "entity_time_rows", tuple(_RRC.split()))),
    *[Query(f"{f}_{p}_validation", lambda t, f=f, p=p: s.output_validation(t, family=f, grain=p),
            _validation(_place_time(f, p), f"{p}_time_rows", _RATIO[f])) for f in _RATIO for p in ("site", "region")],
    *[Query(f"rrc_{p}_validation", lambda t, p=p: s.output_validation(t, family="rrc", grain=p), _validation(
        f"select dataset_family, {p}_code, collect_time, {_RRC_PLACE} from rrc_placed where {p}_code is not null group by all",
        f"{p}_time_rows", tuple(_RRC.split()))) for p in ("site", "region")],

    # --- parameterised results
    Query("kpi_results_entity", lambda t: k.kpi_results_entity(t, family="prb", dataset_family=SDR_CELL, limit=None),
          _entity_rows("prb", SDR_CELL, _newest(SDR_CELL)), " ".join(_RATIO["prb"])),
    Query("kpi_results_entity_bler_window", lambda t: k.kpi_results(
        t, family="bler", grain="entity-time", dataset_family=SDR_CELL, collect_time_from=_FROM, collect_time_to=_TO, limit=None),
        _entity_rows("bler", SDR_CELL, _RANGE), " ".join(_RATIO["bler"])),
    Query("kpi_results_entity_rrc", lambda t: k.kpi_results(t, family="rrc", grain="entity-time", dataset_family=SDR_CELL, limit=None),
          _RRC_RESULT, _RRC),
    Query("paging", lambda t: k.kpi_results(t, family="prb", grain="entity-time", dataset_family=ITBBU_CELL, collect_time_from=_FROM,
                                            limit=40, offset=25), f"""
        select * from ({_entity_rows("prb", ITBBU_CELL, "collect_time >= cast('2026-03-01 06:00' as timestamp)")})
        order by collect_time desc, logical_entity_key limit 40 offset 25""", " ".join(_RATIO["prb"])),
    Query("kpi_results_rollup", lambda t: k.kpi_results(
        t, family="prb", grain="region-time", dataset_family=SDR_CELL, collect_time_from=_FROM, collect_time_to=_TO, limit=None),
        _rollup_rows("prb", "region", SDR_CELL, _RANGE), " ".join(_RATIO["prb"])),
    Query("kpi_results_rollup_site", lambda t: k.kpi_results(
        t, family="bler", grain="site-time", dataset_family=ITBBU_CELL, site_code="SITE7", collect_time_from=_FROM, limit=None),
        _rollup_rows("bler", "site", ITBBU_CELL, "collect_time >= cast('2026-03-01 06:00' as timestamp)", "site_code = 'SITE7'"),
        " ".join(_RATIO["bler"])),
    Query("kpi_results_rrc_rollup", lambda t: k.kpi_results(
        t, family="rrc", grain="region-time", dataset_family=ITBBU_CELL, collect_time_from=_FROM, collect_time_to=_TO, limit=None), f"""
        select dataset_family, region_code, collect_time, {_RRC_PLACE} from rrc_placed
        where region_code is not null and dataset_family = '{ITBBU_CELL}' and {_RANGE} group by all""", _RRC),
    *[Query(f"kpi_validation_entity{'' if f == 'prb' else '_' + f}", lambda t, f=f: k.kpi_validation_entity(t, family=f), _fast_validation(f))
      for f in _RATIO],
    Query("kpi_validation_entity_platform", lambda t: k.kpi_validation(
        t, family="prb", grain="entity-time", dataset_family=ITBBU_PLATFORM), _fast_validation("prb", f"i.dataset_family = '{ITBBU_PLATFORM}'")),
    Query("kpi_validation", lambda t: k.kpi_validation(t, family="prb", grain="site-time", dataset_family=SDR_CELL),
          f"select * from ({_validation(_place_time('prb', 'site'), 'site_time_rows', _RATIO['prb'])}) where dataset_family = '{SDR_CELL}'"),
]
