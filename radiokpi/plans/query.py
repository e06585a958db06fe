"""A registered query: the Spark plan and, where SQL can say it, the DuckDB statement for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from radiokpi.plans.derived import DerivedTables, Dialect, definitions, with_parts
from radiokpi.tables import Tables

# (digits, what is added before rounding) below and from ``LARGE`` on: about twelve digits that count. The added number is
# far below the last digit; an exact half of it, such as 0.01 / 32, then rounds the same way whatever the order of summation.
LARGE = 1_000_000
SMALL_DIGITS, LARGE_DIGITS = (6, 0.00000001234), (4, 0.000001234)

_KEY = """case dataset_family
  when 'PM/sdr/ltefdd' then concat('family=', dataset_family, '|sbnid=', sbnid, '|enodebid=', enodebid, '|cellid=', cellid)
  when 'PM/itbbu/ltefdd' then concat('family=', dataset_family, '|sbnid=', sbnid, '|enbid=', enbid, '|cellid=', cellid)
  when 'PM/itbbu/itbbuplat' then concat('family=', dataset_family, '|sbnid=', sbnid, '|meid=', meid)
  else concat('family=', ifnull(dataset_family, 'UNKNOWN'), '|sbnid=', sbnid, '|enbid=', enbid, '|enodebid=', enodebid,
    '|cellid=', cellid, '|meid=', meid, '|ani=', ani) end"""
_LEVEL = "case when dataset_family like '%/ltefdd' then 'cell' when dataset_family like '%/itbbuplat' then 'meid' else 'raw' end"
PLACES = "site_code, site_name, region_code, region_name, reporting_key, reporting_name, reporting_level"

# Intermediate results several checks share.
SHARED = {
    "keyed": f"select *, {_KEY} as logical_entity_key, {_LEVEL} as own_level from pm_sample",
    "raw_entity": """select k.*, ifnull(i.entity_level, own_level) as entity_level
        from keyed k left join entity_identity i using (logical_entity_key)""",
    "shapes": f"""select distinct dataset_family, sbnid, enbid, enodebid, cellid, meid, ani,
        {_KEY} as logical_entity_key, {_LEVEL} as entity_level from pm_wide""",
    "topo_enrichment": """select i.logical_entity_key, i.dataset_family, i.entity_level, m.site_code, s.site_name, s.region_code,
        r.region_name, m.reporting_key, h.reporting_name, h.reporting_level,
        if(m.site_code is null, 'UNMAPPED', 'MAPPED') as mapping_status
        from entity_identity i left join topo_entity_map m using (logical_entity_key)
        left join topo_site s on s.site_code = m.site_code left join topo_region r on r.region_code = s.region_code
        left join topo_reporting h on h.reporting_key = m.reporting_key""",
    "placed": f"""select f.*, {PLACES}, mapping_status from raw_entity f
        left join (select logical_entity_key, {PLACES}, mapping_status from topo_enrichment) as p using (logical_entity_key)""",
    "base_inputs": f"""select p.dataset_family, collect_time, interval_start, logical_entity_key, p.entity_level, {PLACES},
        counter_alias, aggregation_behavior, d.unit, sum(counter_value) as sum_counter_value, avg(counter_value) as avg_counter_value,
        min(counter_value) as min_counter_value, max(counter_value) as max_counter_value, count(*) as row_count
        from placed p join counter_dictionary d on d.dataset_family = p.dataset_family and d.counter_id = p.counter_id
        group by all""",
    "input_coverage": """select i.kpi_code, f.kpi_name, i.input_alias, i.dataset_family, i.counter_alias, i.required,
        d.verification_status as counter_verification_status, count(distinct b.logical_entity_key) as distinct_logical_entities,
        count(distinct b.collect_time) as distinct_collect_times, cast(ifnull(sum(b.row_count), 0) as bigint) as row_count
        from kpi_formula_input i join kpi_formula f using (kpi_code)
        left join counter_dictionary d on d.dataset_family = i.dataset_family and d.counter_alias = i.counter_alias
        left join base_inputs b on b.dataset_family = i.dataset_family and b.counter_alias = i.counter_alias group by all""",
    "ratio_inputs": """select i.kpi_code, f.kpi_name, f.unit as kpi_unit, f.topology_rollup_allowed, i.input_alias, b.*
        from kpi_formula f join kpi_formula_input i on i.kpi_code = f.kpi_code and i.required
        join counter_dictionary d on d.dataset_family = i.dataset_family and d.counter_alias = i.counter_alias
        join base_inputs b on b.dataset_family = i.dataset_family and b.counter_alias = i.counter_alias
        where f.verification_status = 'VERIFIED' and d.verification_status = 'VERIFIED'
          and b.aggregation_behavior = 'SUM' and b.unit = 'Number' and f.kpi_code in
          ('dl_prb_utilization', 'ul_prb_utilization', 'dl_bler', 'ul_bler')""",
    "ratio_entity": f"""select kpi_code, kpi_name, dataset_family, collect_time, interval_start, logical_entity_key, entity_level,
        {PLACES}, numerator_counter_alias, denominator_counter_alias, n as numerator_value, d as denominator_value,
        100 * n / nullif(d, 0) as kpi_value, kpi_unit as unit, topology_rollup_allowed
        from (select kpi_code, kpi_name, kpi_unit, topology_rollup_allowed, dataset_family, collect_time, interval_start,
          logical_entity_key, entity_level, {PLACES},
          max(if(input_alias = 'numerator', counter_alias, null)) as numerator_counter_alias,
          max(if(input_alias = 'denominator', counter_alias, null)) as denominator_counter_alias,
          sum(if(input_alias = 'numerator', sum_counter_value, null)) as n,
          sum(if(input_alias = 'denominator', sum_counter_value, null)) as d, count(distinct input_alias) as inputs
          from ratio_inputs group by all) where inputs = 2""",
    "rrc_entity": """select b.dataset_family, logical_entity_key, collect_time,
        max(if(b.counter_alias = 'max_rrc_connected_users', max_counter_value, null)) as rrc_connected_users_max,
        max(if(b.counter_alias = 'mean_rrc_connected_users', avg_counter_value, null)) as rrc_connected_users_mean,
        max(if(b.counter_alias = 'online_rrc_connected_users', sum_counter_value, null)) as rrc_connected_users_online
        from base_inputs b semi join (select * from counter_dictionary where verification_status = 'VERIFIED') v
          on v.dataset_family = b.dataset_family and v.counter_alias = b.counter_alias
        where b.dataset_family like '%/ltefdd' and b.counter_alias like '%rrc_connected_users' group by all""",
    "rrc_placed": """select r.*, p.site_code, p.region_code from rrc_entity r
        join topo_enrichment p on p.logical_entity_key = r.logical_entity_key and p.dataset_family = r.dataset_family""",
    "cells": """select dataset_family, collect_time, interval_start, count(distinct logical_entity_key) as distinct_cell_entities
        from raw_entity where entity_level = 'cell' group by all""",
    "daily": """select dataset_family, cast(cast(collect_time as date) as varchar) as collect_date, count(*) as row_count,
        count(distinct source_file) as distinct_source_files, count(distinct collect_time) as distinct_collect_times,
        count(distinct logical_entity_key) as distinct_logical_entities,
        count(distinct if(entity_level = 'cell', logical_entity_key, null)) as distinct_cell_entities from raw_entity group by all""",
}


@dataclass(frozen=True)
class Query:
    """``build`` gets the derived tables; ``doubles`` names the columns the statement must round."""

    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None
    doubles: str = ""

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        return comparable(self.build(DerivedTables(spark, directory)))

    def statement(self) -> str | None:
        if self.sql is None:
            return None
        parts = definitions(Dialect(spark=False)) | SHARED
        text = f"select * from ({self.sql}) as result"
        if self.doubles:
            def shown(c: str, digits: int, nudge: float) -> str:
                return f"round({c}::double + {nudge:.11f}::double, {digits})"

            rounded = ", ".join(f"if(abs({c}) < {LARGE}, {shown(c, *SMALL_DIGITS)}, {shown(c, *LARGE_DIGITS)}) as {c}" for c in self.doubles.split())
            text = f"select * replace ({rounded}) from ({self.sql}) as result"
        return with_parts(text, parts)


def comparable(frame: DataFrame) -> DataFrame:
    """Doubles rounded, arrays as joined text (with NULL spelled out) and dates as text, so results compare by value across engines."""
    def shown(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            value = column.cast("double")
            small, large = (F.round(value + F.lit(nudge), digits) for digits, nudge in (SMALL_DIGITS, LARGE_DIGITS))
            return F.when(F.abs(value) < LARGE, small).otherwise(large).alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(column, ",", "NULL").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return column.cast("string").alias(field.name)
        return column
    return frame.select(*[shown(f) for f in frame.schema])
