"""The driver's tables as entities, terms, relationships, references and users.

entity: orders, in the site (region) of their customer; parent is the order whose key has one digit less.
term: parts, in taxonomies by type; relationship: distinct order and part of lineitem.
meta: events, referring to the entity in their props; user: customers, with their segment as role.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def up(column: str):
    """The id with its last digit cut off, or null."""
    up_id = F.expr(f"{column} div 10")
    return F.when(up_id > 0, up_id)


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def customer_site(self) -> DataFrame:
        nation = self.read("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("site"))
        return self.read("customer").join(nation, "c_nationkey")  # 25 nations: below any broadcast threshold

    @cached_property
    def entity(self) -> DataFrame:
        who = self.customer_site.select(F.col("c_custkey").alias("o_custkey"), "site")
        return self.read("orders").join(who, "o_custkey").select(
            "site", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("author"),
            up("o_orderkey").alias("parent"), F.col("o_orderdate").alias("date"), F.floor("o_totalprice").alias("bytes"),
        )

    @cached_property
    def relationship(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_partkey").alias("term_id")).distinct()

    @cached_property
    def term(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("term_id"), F.col("p_type").alias("taxonomy"), F.col("p_name").alias("name"), up("p_partkey").alias("parent"))

    @cached_property
    def meta(self) -> DataFrame:
        ref = F.get_json_object("props", "$.k").try_cast("bigint")
        return self.read("events").select(F.col("event_id").alias("meta_id"), F.col("event_id").alias("post_id"), F.col("event_type").alias("meta_key"), F.col("props").alias("value"), ref.alias("ref_id"), F.length("props").cast("long").alias("bytes"))

    @cached_property
    def user(self) -> DataFrame:
        return self.customer_site.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("role"), "site")


#: The same as a chain of DuckDB common table expressions.
CTE = """entity AS (SELECT n_regionkey AS site, o_orderkey AS id, o_orderpriority AS type, o_orderstatus AS status, o_custkey AS author,
  CASE WHEN o_orderkey // 10 > 0 THEN o_orderkey // 10 END AS parent, o_orderdate AS date, CAST(floor(o_totalprice) AS BIGINT) AS bytes
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
relationship AS (SELECT DISTINCT l_orderkey AS object_id, l_partkey AS term_id FROM lineitem),
term AS (SELECT p_partkey AS term_id, p_type AS taxonomy, p_name AS name, CASE WHEN p_partkey // 10 > 0 THEN p_partkey // 10 END AS parent FROM part),
meta AS (SELECT event_id AS meta_id, event_id AS post_id, event_type AS meta_key, props AS value, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS ref_id, CAST(length(props) AS BIGINT) AS bytes FROM events),
member AS (SELECT c_custkey AS id, c_mktsegment AS role, n_regionkey AS site FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
