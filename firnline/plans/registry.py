"""All queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firnline.plans import catalog_queries, digest_queries, domain_queries, event_queries, family_queries, identity_queries, oracle_catalog, oracle_digest, oracle_domain, oracle_events, oracle_family, oracle_identity, oracle_shop, oracle_store, shop_queries, store_queries

MODULES = [event_queries, catalog_queries, domain_queries, store_queries, identity_queries, family_queries, shop_queries, digest_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**oracle_events.ORACLE, **oracle_catalog.ORACLE, **oracle_domain.ORACLE, **oracle_store.ORACLE, **oracle_identity.ORACLE, **oracle_family.ORACLE, **oracle_shop.ORACLE, **oracle_digest.ORACLE}
