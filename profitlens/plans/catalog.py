"""Registry: query name → (spark callable over a data directory, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profitlens import constants as K
from profitlens.plans import charts as Ch
from profitlens.plans import concentration as C
from profitlens.plans import customers as Cu
from profitlens.plans import factories as Fa
from profitlens.plans import load_reports as Ld
from profitlens.plans import overall as O
from profitlens.plans import products as P
from profitlens.sources.proxy import Star

Report = Callable[[Star], DataFrame]

# name -> function of the star schema
REPORTS: dict[str, Report] = {
    # data quality (Q1-Q6)
    "row_count": lambda s: O.row_count(s.fact_keys),
    "null_counts": lambda s: O.null_counts(s.fact),
    "loss_rows": lambda s: O.loss_rows(s.fact),
    "zero_profit_rows": lambda s: O.zero_profit_rows(s.fact),
    "cost_gt_sales": lambda s: O.cost_gt_sales(s.fact),
    "margin_over_100": lambda s: O.margin_over_100(s.v),
    "quality_summary": lambda s: O.quality_summary(s.fact),
    # overall (A1-A9, U1)
    "kpi_totals": lambda s: O.kpi_totals(s.v),
    "kpi_margin": lambda s: O.kpi_margin(s.v),
    "chart_overall_kpis": lambda s: O.chart_overall_kpis(s.v),
    "margin_distribution": lambda s: O.margin_distribution(s.v),
    "margin_min_max_avg": lambda s: O.margin_min_max_avg(s.v),
    "margin_quick_split": lambda s: O.margin_quick_split(s.v),
    "margin_sub_bands": lambda s: O.margin_sub_bands(s.v),
    "margin_groups": lambda s: O.margin_groups(s.v),
    "margin_volume_all_bands": lambda s: O.margin_volume_all_bands(s.v),
    "margin_volume_table_bands": lambda s: O.margin_volume_of(s.v, s.bands),
    "sub_band_share": lambda s: O.sub_band_share(s.v),
    # products (A10-A15)
    "top_products_high_margin": lambda s: P.top_products_high_margin(s.v, s.product),
    "top_products_60_70": lambda s: P.top_products_in_band(s.v, s.product, *K.CORE_BANDS[0]),
    "top_products_70_80": lambda s: P.top_products_in_band(s.v, s.product, *K.CORE_BANDS[1]),
    "top_products_per_band": lambda s: P.top_products_per_band(s.v, s.product),
    "low_margin_products": lambda s: P.low_margin_products(s.v, s.product),
    "extreme_margin_products": lambda s: P.extreme_margin_products(s.v, s.product),
    # product profitability
    "product_profitability": lambda s: P.product_profitability(s.fact, s.product),
    "best_products_by_margin": lambda s: P.best_products_by_margin(s.fact, s.product),
    "worst_products_by_margin": lambda s: P.worst_products_by_margin(s.fact, s.product),
    "best_worst_6_products": lambda s: P.best_worst_6_products(s.fact, s.product),
    "product_totals": lambda s: P.product_totals(s.fact, s.product),
    "product_margin_table": lambda s: P.product_margin_table(s.fact, s.product),
    "best_worst_product_by_margin": lambda s: P.best_worst_product_by_margin(s.fact, s.product),
    "best_worst_product_by_gp": lambda s: P.best_worst_product_by_gp(s.fact, s.product),
    "product_profit_share": lambda s: P.product_profit_share(s.fact, s.product),
    "chart_product_gp": lambda s: P.chart_product_gp(s.fact, s.product),
    "chart_product_margin": lambda s: P.chart_product_margin(s.fact, s.product),
    "chart_product_share": lambda s: P.chart_product_share(s.fact, s.product),
    # factories
    "top_factories_high_margin": lambda s: Fa.top_factories_high_margin(s.v),
    "top_factories_per_band": lambda s: Fa.top_factories_per_band(s.v),
    "factory_profit_high_margin": lambda s: Fa.factory_profit_high_margin(s.v),
    "extreme_margin_factories": lambda s: Fa.extreme_margin_factories(s.v),
    "product_factory_dependency": lambda s: Fa.product_factory_dependency(s.v, s.product),
    "factory_margin_stability": lambda s: Fa.factory_margin_stability(s.v_by_order, s.order),
    "factory_unit_economics": lambda s: Fa.factory_unit_economics(s.v),
    # concentration and charts
    "profit_concentration": lambda s: C.profit_concentration(s.v, s.product),
    "pareto_products": lambda s: C.pareto_profit_share(C.profit_concentration(s.v, s.product), K.ENTITY_PRODUCT, 10),
    "pareto_factories": lambda s: C.pareto_profit_share(C.profit_concentration(s.v, s.product), K.ENTITY_FACTORY, 10),
    "running_profit_share": lambda s: C.running_profit_share(s.v),
    "volume_vs_margin": lambda s: C.volume_vs_margin(C.profit_concentration(s.v, s.product)),
    "product_bubble": lambda s: C.product_bubble(C.profit_concentration(s.v, s.product)),
    "top10_products_asc": lambda s: C.top10_products_asc(C.profit_concentration(s.v, s.product)),
    "chart_margin_groups": lambda s: Ch.chart_margin_groups(s.v),
    "chart_band_volume": lambda s: Ch.chart_band_volume(s.v),
    "chart_band_profit": lambda s: Ch.chart_band_profit(s.v),
    # customers
    "customer_profit": lambda s: Cu.customer_profit(s.fact_by_order, s.order),
    "best_worst_customer": lambda s: Cu.best_worst_customer(s.fact_by_order, s.order),
    "customer_products_by_units": lambda s: Cu.customer_products_by_units(s.fact_by_order, s.order, s.product),
    "customer_products_by_gp": lambda s: Cu.customer_products_by_gp(s.fact_by_order, s.order, s.product),
    "customer_products_units_gp": lambda s: Cu.customer_products_units_gp(s.fact_by_order, s.order, s.product),
    "best_customer_top5": lambda s: Cu.best_customer_top5(s.fact_by_order, s.order, s.product),
    "best_customer_top5_by_id": lambda s: Cu.best_customer_top5_by_id(s.fact_by_order, s.order, s.product),
    "best_customer_bottom10": lambda s: Cu.best_customer_bottom10(s.fact_by_order, s.order, s.product),
    # stated questions (G1-G4, G6, G7; G5 is best_worst_6_products)
    "country_profit": lambda s: Cu.country_profit(s.fact_by_order, s.order, s.customer),
    "top_states_best_country": lambda s: Cu.top_states_best_country(s.fact_by_order, s.order, s.customer),
    "top_cities_best_region": lambda s: Cu.top_cities_best_region(s.fact_by_order, s.order, s.customer),
    "customer_profit_vs_orders": lambda s: Cu.customer_profit_vs_orders(s.fact_by_order, s.order),
    "loss_makers": lambda s: Cu.loss_makers(s.fact_by_order, s.order),
    "top_customers_discount": lambda s: Cu.top_customers_discount(s.fact_by_order, s.order),
    # load pipeline (B1-B13) and quality
    "enriched_raw": Ld.enriched_raw,
    "composite_order_ids": Ld.composite_order_ids,
    "dim_customer": Ld.dim_customer,
    "dim_order": Ld.dim_order,
    "dim_factory": Ld.dim_factory,
    "dim_product": Ld.dim_product,
    "order_ids": Ld.order_ids,
    "fact_load": Ld.fact_load,
    "pk_violations": Ld.pk_violations,
    "fk_orphans": Ld.fk_orphans,
    "early_load_orphans": Ld.early_load_orphans,
    "repeated_load": Ld.repeated_load,
    "multi_city_customers": Ld.multi_city_customers,
    "multi_postal_customers": Ld.multi_postal_customers,
    "factory_products": Ld.factory_products,
    "shared_products": Ld.shared_products,
    "unmapped_keys": Ld.unmapped_keys,
    "column_domains": Ld.column_domains,
}


def portable(df: DataFrame) -> DataFrame:
    """Output convention of registered queries: decimals as double, dates/timestamps as ISO text,
    so results compare by value across engines."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Report):
        return lambda spark, sf_dir: portable(fn(Star(spark, sf_dir)))

    return {name: bind(fn) for name, fn in REPORTS.items()}


def oracle_queries() -> dict[str, str]:
    from profitlens.oracles import ORACLES

    return {k: v for k, v in ORACLES.items() if k in REPORTS}
