"""The queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import ids, php, refs
from quarry.operators import checks, closure, finish, keep, match, profile, seeds
from quarry.sources import config, dump, sqldump, store

from . import finishing, subset
from .bindings import CTE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of Tables under its name, with its SQL; {cte} there stands for the bindings."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql.replace("{cte}", CTE).replace("{keep}", KEEP_SQL).replace("{edges}", EDGES_SQL)
        return f

    return add


#: Kept in most queries: the newest 400 urgent orders.
KEEP_SQL = "keep AS (SELECT site, id, 0 AS depth, 'type:1-URGENT:latest' AS reason FROM entity WHERE type = '1-URGENT' ORDER BY date DESC NULLS LAST, id DESC LIMIT 400)"
KEYS = ("purchase", "signup")
CHILD = ("5-LOW",)
ATTACHMENT = "4-NOT SPECIFIED"
EDGES_SQL = """raw_edges AS (
  SELECT e.site, m.post_id AS src, m.ref_id AS dst, 'meta:' || m.meta_key AS reason FROM meta m JOIN entity e ON e.id = m.post_id WHERE m.meta_key IN ('purchase', 'signup')
  UNION ALL SELECT site, id, parent, 'parent' FROM entity WHERE parent > 0 AND type <> '4-NOT SPECIFIED'
  UNION ALL SELECT site, parent, id, 'child:' || type FROM entity WHERE parent > 0 AND type IN ('5-LOW')),
edges AS (SELECT r.site, r.src, r.dst, r.reason, e.type = '4-NOT SPECIFIED' AS to_attachment FROM raw_edges r JOIN entity e ON e.site = r.site AND e.id = r.dst)"""


def base_keep(t: Tables) -> DataFrame:
    return seeds.newest(t.entity.where("type = '1-URGENT'"), 400, "type:1-URGENT:latest").select("site", "id", F.lit(0).alias("depth"), "reason")


def base_edges(t: Tables) -> DataFrame:
    own = t.meta.where(F.col("meta_key").isin(*KEYS)).join(t.entity.select("site", F.col("id").alias("post_id")), "post_id")
    follow = own.sparkSession.createDataFrame([(s, k, "meta:" + k) for s in range(5) for k in KEYS], "site int, meta_key string, reason string")
    return closure.edges_of(t.entity, own, follow, CHILD, ATTACHMENT)


# Seeds ------------------------------------------------------------------------------------------------------------


@query("WITH {cte} SELECT site, id, 'type:2-HIGH:latest' AS reason FROM entity WHERE type = '2-HIGH' AND status IN ('F', 'O') ORDER BY date DESC NULLS LAST, id DESC LIMIT 50")
def seed_latest_n(t: Tables) -> DataFrame:
    return seeds.newest(t.entity.where("type = '2-HIGH' and status in ('F', 'O')"), 50, "type:2-HIGH:latest")


@query("""WITH {cte} SELECT site, id, reason FROM (
  SELECT site, id, 'type:' || type || ':latest' AS reason, row_number() OVER (PARTITION BY site, type ORDER BY date DESC NULLS LAST, id DESC) AS rn FROM entity WHERE type <> '3-MEDIUM') WHERE rn <= 10
  UNION ALL SELECT site, id, 'type:3-MEDIUM:all' FROM entity WHERE type = '3-MEDIUM'""")
def seed_rules(t: Tables) -> DataFrame:
    types = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    rows = [(s, k, None if k == "3-MEDIUM" else 10, f"type:{k}:" + ("all" if k == "3-MEDIUM" else "latest")) for s in range(5) for k in types]
    return seeds.newest_per_type(t.entity, t.spark.createDataFrame(rows, "site int, type string, count int, reason string"))


@query("""WITH {cte}, a AS (SELECT site, id, 'always kept' AS reason FROM entity WHERE type = '5-LOW' AND status = 'F'),
b AS (SELECT site, id, 'type:1-URGENT:status:P' AS reason FROM entity WHERE type = '1-URGENT' AND status = 'P' ORDER BY date DESC NULLS LAST, id DESC LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b""")
def seed_status_extra(t: Tables) -> DataFrame:
    always = t.entity.where("type = '5-LOW' and status = 'F'").select("site", "id", F.lit("always kept").alias("reason"))
    return always.unionByName(seeds.newest(t.entity.where("type = '1-URGENT' and status = 'P'"), 20, "type:1-URGENT:status:P"))


PER_TERM_SQL = """WITH {cte}, eligible AS (SELECT * FROM entity WHERE status IN ('F', 'O')), own AS (SELECT * FROM term WHERE taxonomy = 'PROMO'),
c AS (SELECT term_id, count(*) AS n FROM relationship JOIN eligible ON id = object_id GROUP BY 1),
top AS (SELECT term_id FROM own JOIN c USING (term_id) ORDER BY %s LIMIT 10),
chosen AS (SELECT term_id FROM top UNION SELECT term_id FROM own WHERE name LIKE 'blue%%')
SELECT site, id, term_id, rn, 'type:order:per_term:PROMO' AS reason FROM (
  SELECT site, id, r.term_id, row_number() OVER (PARTITION BY r.term_id ORDER BY date DESC NULLS LAST, id DESC) AS rn
  FROM relationship r JOIN chosen USING (term_id) JOIN eligible ON id = object_id) WHERE rn <= 5"""


def per_term(t: Tables, by_name: bool) -> DataFrame:
    eligible, own = t.entity.where("status in ('F', 'O')"), t.term.where("taxonomy = 'PROMO'")
    chosen = seeds.top_terms(eligible, t.relationship, own, 10, by_name).select("term_id").union(own.where(F.col("name").startswith("blue")).select("term_id")).distinct()
    return seeds.newest_per_term(eligible, t.relationship, chosen, 5, "type:order:per_term:PROMO")


@query(PER_TERM_SQL % "n DESC, term_id")
def seed_per_term(t: Tables) -> DataFrame:
    return per_term(t, False)


@query(PER_TERM_SQL % "name NULLS LAST, term_id")
def seed_per_term_by_name(t: Tables) -> DataFrame:
    return per_term(t, True)


@query("""WITH {cte}, s AS (SELECT site, id, 'type:' || type AS reason FROM entity WHERE bytes > 300000 UNION ALL SELECT site, id, 'status:' || status FROM entity WHERE status = 'P'
  UNION ALL SELECT 0, 10000000 + id, 'none' FROM entity WHERE id < 10)
SELECT e.site, e.id, 0 AS depth, min(s.reason) AS reason FROM s JOIN entity e ON e.site = s.site AND e.id = s.id GROUP BY 1, 2""")
def seed_min_reason(t: Tables) -> DataFrame:
    e = t.entity
    found = e.where("bytes > 300000").select("site", "id", F.concat(F.lit("type:"), "type").alias("reason"))
    found = found.unionByName(e.where("status = 'P'").select("site", "id", F.concat(F.lit("status:"), "status").alias("reason")))
    lost = e.where("id < 10").select(F.lit(0).alias("site"), (F.col("id") + 10000000).alias("id"), F.lit("none").alias("reason"))
    return seeds.keep_seeds(found.unionByName(lost), e)


@query("""WITH o AS (SELECT event_id % 5 AS site, 'page_on_' || event_type AS name, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 3 = 1 THEN '-4' ELSE props END AS value FROM events)
SELECT CAST(site AS INTEGER) AS site, CAST(value AS BIGINT) AS id, 'option:' || name AS reason FROM o WHERE name IN ('page_on_view', 'page_on_click') AND regexp_full_match(value, '[0-9]{1,18}') AND CAST(value AS BIGINT) > 0""")
def seed_options(t: Tables) -> DataFrame:
    e = F.col("event_id")
    options = t.read("events").select((e % 5).cast("int").alias("site"), F.concat(F.lit("page_on_"), "event_type").alias("name"), F.when(e % 3 == 0, e.cast("string")).when(e % 3 == 1, "-4").otherwise(F.col("props")).alias("value"))
    return seeds.option_seeds(options, ("page_on_view", "page_on_click"))


@query("""WITH {cte}, n AS (SELECT site, id, CASE WHEN id % 11 = 0 THEN NULL ELSE type END AS type, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN 'auto-draft' ELSE status END AS status FROM entity)
SELECT * FROM n WHERE type NOT IN ('3-MEDIUM', '5-LOW') AND coalesce(status, '') <> 'auto-draft'""")
def drop_filter(t: Tables) -> DataFrame:
    i = F.col("id")
    own = t.entity.select("site", "id", F.when(i % 11 != 0, F.col("type")).alias("type"), F.when(i % 7 == 1, "auto-draft").when(i % 7 != 0, F.col("status")).alias("status"))
    return seeds.drop_filter(own, ("3-MEDIUM", "5-LOW"))


# References -------------------------------------------------------------------------------------------------------


@query("WITH {cte}, {edges} SELECT * FROM edges")
def edges_union(t: Tables) -> DataFrame:
    return base_edges(t)


def _levels(depth: int, rounds: int) -> str:
    """The closure's rounds as one statement."""
    parts = ["WITH {cte}, {keep}, {edges}, u0 AS (SELECT site, id, depth, reason FROM keep)"]
    for d in range(1, rounds + 1):
        # Up to the depth all edges from the round before; after it exempt edges, in its first round from all that is kept.
        source = f"k.depth = {d - 1}" if d <= depth else "(e.to_attachment OR e.reason IN ('parent', 'menu:target') OR e.reason LIKE 'child:%')"
        parts.append(f"u{d} AS (SELECT * FROM u{d - 1} UNION ALL SELECT e.site, e.dst, {d}, min(e.reason) FROM edges e JOIN u{d - 1} k ON k.site = e.site AND k.id = e.src WHERE {source} AND NOT EXISTS (SELECT 1 FROM u{d - 1} o WHERE o.site = e.site AND o.id = e.dst) GROUP BY 1, 2)")
    return ",\n".join(parts) + f"\nSELECT site, id, CAST(depth AS INTEGER) AS depth, reason FROM u{rounds}"


@query(_levels(2, 2))
def closure_depth2(t: Tables) -> DataFrame:
    return closure.closure(base_keep(t), base_edges(t), depth=2, exempt_rounds=0)


@query(_levels(2, 9))
def closure_exempt(t: Tables) -> DataFrame:
    return closure.closure(base_keep(t), base_edges(t), depth=2)


@query(_levels(0, 7))
def closure_depth0(t: Tables) -> DataFrame:
    return closure.closure(base_keep(t), base_edges(t), depth=0)


@query(f"WITH final AS ({_levels(2, 9)}) SELECT site, reason, count(*) AS n FROM final WHERE depth > 0 GROUP BY 1, 2")
def added_by_reason(t: Tables) -> DataFrame:
    return profile.added_by_reason(closure.closure(base_keep(t), base_edges(t), depth=2))


@query("""WITH RECURSIVE {cte}, {keep}, tree AS (SELECT term_id, 'part' AS taxonomy, parent FROM term), anc AS (SELECT * FROM tree WHERE term_id IN (SELECT term_id FROM relationship JOIN keep ON id = object_id)
  UNION SELECT t.* FROM tree t JOIN anc a ON t.term_id = a.parent AND t.taxonomy = a.taxonomy WHERE a.parent > 0) SELECT * FROM anc""")
def term_ancestors(t: Tables) -> DataFrame:
    tree = t.term.select("term_id", F.lit("part").alias("taxonomy"), "parent")
    used = t.relationship.join(base_keep(t).select(F.col("id").alias("object_id")), "object_id", "left_semi").select("term_id").distinct()
    return closure.ancestors(tree.join(used, "term_id", "left_semi"), tree)


@query("""WITH {cte}, i AS (SELECT event_id, props, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_id || ',' || (event_id + 1) WHEN 2 THEN '[' || event_id || ',"7"]' ELSE '3,x' END AS value FROM events),
p AS (SELECT event_id, regexp_extract_all(value, '[0-9]+') AS parts, value FROM i)
SELECT event_id, CAST(unnest(parts) AS BIGINT) AS ref_id FROM p WHERE event_id % 4 < 3 AND event_id > 0""")
def list_ids(t: Tables) -> DataFrame:
    e = F.col("event_id")
    s = e.cast("string")
    value = F.when(e % 4 == 0, s).when(e % 4 == 1, F.concat(s, F.lit(","), (e + 1).cast("string"))).when(e % 4 == 2, F.concat(F.lit("["), s, F.lit(',"7"]'))).otherwise("3,x")
    return t.read("events").select("event_id", value.alias("value")).select("event_id", F.explode(ids.list_ids("value")).alias("ref_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ref_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 0")
def json_ids(t: Tables) -> DataFrame:
    value = F.from_json("props", "map<string,string>")["k"]
    return t.read("events").select("event_id", F.explode(refs.json_ids(value)).alias("ref_id"))


@query("""SELECT event_id, unnest(CASE event_id % 6 WHEN 0 THEN [event_id * 1000] WHEN 1 THEN [event_id, 7] WHEN 2 THEN [event_id, event_id + 1, 3] WHEN 5 THEN [event_id] END) AS ref_id FROM events WHERE event_id > 0 AND event_id % 6 IN (0, 1, 2, 5)""")
def json_values(t: Tables) -> DataFrame:
    """Whole numbers with exponents, strings with signs, nested arrays; lists within strings, fractions and words are no ids."""
    s = F.col("event_id").cast("string")
    kinds = [F.concat(s, F.lit("e3")), F.concat(F.lit("["), s, F.lit(',"+7",-5,"x,7",0]')), F.concat(F.lit("[["), s, F.lit(',["'), (F.col("event_id") + 1).cast("string"), F.lit('"]],[[3.0]],{"a":4}]')), F.concat(F.lit('"'), s, F.lit(',7"')), F.concat(s, F.lit(".5")), F.concat(F.lit('"'), s, F.lit('"'))]
    value = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        value = F.when(F.col("event_id") % 6 == i, kind).otherwise(value)
    return t.read("events").where("event_id > 0").select("event_id", F.explode(refs.json_ids(value)).alias("ref_id"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def extract_hrefs(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


# Keep sets --------------------------------------------------------------------------------------------------------


@query("""WITH {cte}, {keep}, marked AS (SELECT term_id, taxonomy, CASE WHEN taxonomy IN ('PROMO', 'SMALL') THEN 0 ELSE coalesce(parent, 0) END AS parent FROM term),
big AS (SELECT taxonomy FROM marked GROUP BY 1 HAVING count(*) > 20 AND NOT bool_or(parent > 0)), used AS (SELECT DISTINCT term_id FROM relationship JOIN keep ON id = object_id)
SELECT * FROM marked m WHERE NOT EXISTS (SELECT 1 FROM big b WHERE b.taxonomy = m.taxonomy) OR EXISTS (SELECT 1 FROM used u WHERE u.term_id = m.term_id)""")
def big_flat_prune(t: Tables) -> DataFrame:
    parent = F.when(F.col("taxonomy").isin("PROMO", "SMALL"), F.lit(0)).otherwise(F.coalesce("parent", F.lit(0))).cast("long")
    return keep.prune_terms(t.term.select("term_id", "taxonomy", parent.alias("parent")), t.relationship, base_keep(t), 20)


@query("""WITH {cte}, {keep} SELECT r.object_id, r.term_id, t.taxonomy FROM relationship r JOIN term t USING (term_id)
WHERE EXISTS (SELECT 1 FROM keep k WHERE k.id = r.object_id) OR (t.taxonomy = 'LARGE' AND r.term_id % 50 = 0) AND t.taxonomy = 'LARGE'""")
def keep_relationships(t: Tables) -> DataFrame:
    terms = t.term.withColumn("taxonomy", F.when((F.col("taxonomy") == "LARGE") & (F.col("term_id") % 50 == 0), "link_category").otherwise(F.col("taxonomy")))
    found = keep.keep_relationships(t.relationship, terms, base_keep(t), "link_category")
    return found.withColumn("taxonomy", F.when(F.col("taxonomy") == "link_category", "LARGE").otherwise(F.col("taxonomy")))


@query("""WITH {cte}, {keep} SELECT id, role, site FROM member WHERE id IN (SELECT author FROM entity e JOIN keep k ON k.id = e.id) OR id IN (SELECT id FROM member WHERE role IN ('MACHINERY'))""")
def keep_users(t: Tables) -> DataFrame:
    return keep.keep_users(t.user, t.entity, base_keep(t), t.user.where("role = 'MACHINERY'").select("id"))


@query("""WITH {cte}, {keep}, x AS (SELECT meta_id, post_id, CASE WHEN meta_id % 13 = 0 THEN NULL WHEN meta_id % 5 = 0 THEN '_edit_' || meta_key ELSE meta_key END AS meta_key FROM meta)
SELECT * FROM x WHERE NOT (coalesce(meta_key, '') LIKE '!_edit!_%' ESCAPE '!' OR coalesce(meta_key, '') LIKE 's%n!_p' ESCAPE '!' OR coalesce(meta_key, '') LIKE 'pur%ase' ESCAPE '!') AND post_id IN (SELECT id FROM keep)""")
def keep_meta_globs(t: Tables) -> DataFrame:
    i = F.col("meta_id")
    own = t.meta.select("meta_id", "post_id", F.when(i % 13 == 0, F.lit(None)).when(i % 5 == 0, F.concat(F.lit("_edit_"), "meta_key")).otherwise(F.col("meta_key")).alias("meta_key"))
    return keep.keep_meta(own, base_keep(t), ("_edit_*", "s*n_p", "pur*ase"))


@query("WITH {cte}, {keep} SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT id FROM keep)")
def slim_semijoin(t: Tables) -> DataFrame:
    return keep.slim(t.read("lineitem"), base_keep(t).select(F.col("id").alias("l_orderkey")), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("WITH {cte}, k AS (SELECT DISTINCT site, id FROM entity WHERE type = '2-HIGH' AND id % 3 > 0) SELECT e.site, e.id, e.status FROM entity e WHERE (e.site, e.id) IN (SELECT site, id FROM k)")
def slim_filter(t: Tables) -> DataFrame:
    """Rows by (site, id), with the bitmap of the keys in front of the exact join whatever their number."""
    keys = t.entity.where("type = '2-HIGH' and id % 3 > 0").select("site", "id")
    return keep.semi_join(t.entity.select("site", "id", "status"), keys, ["site", "id"], broadcast=0)


@query("""WITH p AS (SELECT r_regionkey + 1 AS site, CASE WHEN r_regionkey = 0 THEN 'wp_' ELSE 'wp_' || (r_regionkey + 1) || '_' END AS prefix FROM region), b AS (SELECT n_nationkey AS site, n_name AS domain, '/' AS path, n_nationkey % 2 = 0 AS public, n_nationkey % 5 = 0 AS deleted FROM nation WHERE n_nationkey <> 2)
SELECT coalesce(p.site, b.site) AS site, coalesce(prefix, CASE WHEN b.site = 1 THEN 'wp_' ELSE 'wp_' || b.site || '_' END) AS prefix, domain, path, public, CASE WHEN b.site IS NOT NULL THEN false END AS archived, deleted, CASE WHEN b.site IS NOT NULL THEN false END AS spam, p.site IS NOT NULL AS has_tables FROM p FULL JOIN b ON p.site = b.site""")
def site_frame(t: Tables) -> DataFrame:
    """Regions as sites that have tables, nations as the network's list of sites."""
    number, region = F.col("n_nationkey"), F.col("r_regionkey") + 1
    prefixes = t.read("region").select(region.alias("site"), F.when(region == 1, "wp_").otherwise(F.concat(F.lit("wp_"), region.cast("string"), F.lit("_"))).alias("prefix"))
    blogs = t.read("nation").where("n_nationkey <> 2").select(number.alias("site"), F.col("n_name").alias("domain"), F.lit("/").alias("path"), (number % 2 == 0).alias("public"), F.lit(False).alias("archived"), (number % 5 == 0).alias("deleted"), F.lit(False).alias("spam"))
    return subset.sites_frame(prefixes, blogs, "wp_")


TERM_RULES = [(s, k, x, ["F", "O"] if s % 2 else ["F"], 2 + s % 3, 3 if x == "PROMO" else None, s % 2 == 0, x == "PROMO", f"type:{k}:per_term:{x}") for s in range(5) for k in ("1-URGENT", "5-LOW") for x in ("PROMO", "SMALL")]


@query("""WITH {cte}, rules AS (SELECT s AS site, k AS type, x AS taxonomy, CASE WHEN s % 2 = 1 THEN ['F', 'O'] ELSE ['F'] END AS statuses, 2 + s % 3 AS per_term, CASE WHEN x = 'PROMO' THEN 3 END AS max_terms, s % 2 = 0 AS by_name, x = 'PROMO' AS linked_too
  FROM range(5) a(s), (VALUES ('1-URGENT'), ('5-LOW')) b(k), (VALUES ('PROMO'), ('SMALL')) c(x)),
pairs AS (SELECT u.*, e.id, e.date, m.term_id, m.name FROM rules u JOIN entity e ON e.site = u.site AND e.type = u.type AND list_contains(u.statuses, e.status) JOIN relationship r ON r.object_id = e.id JOIN term m ON m.term_id = r.term_id AND m.taxonomy = u.taxonomy),
counted AS (SELECT site, type, taxonomy, term_id, any_value(name) AS name, any_value(by_name) AS by_name, any_value(max_terms) AS max_terms, count(*) AS n FROM pairs GROUP BY 1, 2, 3, 4),
placed AS (SELECT *, row_number() OVER (PARTITION BY site, type, taxonomy ORDER BY CASE WHEN by_name THEN name IS NULL END, CASE WHEN by_name THEN name END, CASE WHEN NOT by_name THEN -n END, term_id) AS place FROM counted),
chosen AS (SELECT site, type, taxonomy, term_id FROM placed WHERE max_terms IS NULL OR place <= max_terms UNION SELECT site, type, u.taxonomy, term_id FROM rules u JOIN term m ON m.taxonomy = u.taxonomy AND starts_with(m.name, 'blue') WHERE linked_too),
ranked AS (SELECT site, id, type, taxonomy, per_term, row_number() OVER (PARTITION BY site, type, taxonomy, term_id ORDER BY date DESC NULLS LAST, id DESC) AS rn FROM pairs JOIN chosen USING (site, type, taxonomy, term_id))
SELECT DISTINCT site, id, 'type:' || type || ':per_term:' || taxonomy AS reason FROM ranked WHERE rn <= per_term""")
def seed_per_term_rules(t: Tables) -> DataFrame:
    """Rules of several sites, types and taxonomies, each with its own counts and order, in one plan."""
    own = t.spark.createDataFrame(TERM_RULES, "site int, type string, taxonomy string, statuses array<string>, per_term int, max_terms int, by_name boolean, linked_too boolean, reason string")
    rel = t.relationship.join(t.entity.select("site", F.col("id").alias("object_id")), "object_id").withColumnRenamed("term_id", "term_taxonomy_id")
    terms = rel.select("site", "term_taxonomy_id").distinct().join(t.term.select(F.col("term_id").alias("term_taxonomy_id"), "taxonomy", "name"), "term_taxonomy_id")
    return seeds.per_term(t.entity, rel, terms, terms.where(F.col("name").startswith("blue")).select("site", "taxonomy", "term_taxonomy_id"), own)


@query("""WITH {cte}, {keep}, p AS (SELECT 'orders' AS tbl, count(*) AS planned FROM keep UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT id FROM keep) UNION ALL SELECT 'events', count(*) FROM events),
w AS (SELECT 'orders' AS tbl, count(*) AS written FROM orders WHERE o_orderkey IN (SELECT id FROM keep) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT id FROM keep))
SELECT coalesce(p.tbl, w.tbl) AS tbl, coalesce(planned, 0) AS planned, coalesce(written, 0) AS written, coalesce(planned, 0) = coalesce(written, 0) AS ok FROM p FULL JOIN w ON p.tbl = w.tbl""")
def reconcile_counts(t: Tables) -> DataFrame:
    kept = base_keep(t)
    count = lambda df, name, out: df.agg(F.count("*").alias(out)).select(F.lit(name).alias("tbl"), out)
    lines = keep.slim(t.read("lineitem"), kept.select(F.col("id").alias("l_orderkey")), "l_orderkey")
    orders = keep.slim(t.read("orders"), kept.select(F.col("id").alias("o_orderkey")), "o_orderkey")
    planned = count(kept, "orders", "planned").unionByName(count(lines, "lineitem", "planned")).unionByName(count(t.read("events"), "events", "planned"))
    return keep.reconcile(planned, count(orders, "orders", "written").unionByName(count(lines, "lineitem", "written")))


@query("""WITH {cte}, {keep} SELECT 'posts' AS tbl, count(*) AS n, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM entity WHERE id IN (SELECT id FROM keep)
UNION ALL SELECT 'postmeta', count(*), CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM meta WHERE post_id IN (SELECT id FROM keep)
UNION ALL SELECT 'none', count(*), CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM meta WHERE post_id < 0""")
def size_estimate(t: Tables) -> DataFrame:
    kept = base_keep(t).select("id")
    return profile.size_estimate({"posts": t.entity.join(kept, "id", "left_semi"), "postmeta": t.meta.join(kept.withColumnRenamed("id", "post_id"), "post_id", "left_semi"), "none": t.meta.where("post_id < 0")})


# Profiles ---------------------------------------------------------------------------------------------------------


@query("""WITH {cte}, {keep}, mb AS (SELECT post_id AS id, sum(bytes) AS mb FROM meta GROUP BY 1)
SELECT e.site, e.type, count(*) AS n, CAST(sum(e.bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE k.id IS NOT NULL) AS kept_n, CAST(coalesce(sum(e.bytes) FILTER (WHERE k.id IS NOT NULL), 0) AS BIGINT) AS kept_bytes,
CAST(coalesce(sum(mb) FILTER (WHERE k.id IS NOT NULL), 0) AS BIGINT) AS kept_meta_bytes FROM entity e LEFT JOIN keep k ON k.site = e.site AND k.id = e.id LEFT JOIN mb ON mb.id = e.id GROUP BY 1, 2""")
def type_report(t: Tables) -> DataFrame:
    return profile.type_report(t.entity, base_keep(t), t.meta)


@query("WITH {cte} SELECT site, type, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day, CAST(round(avg(bytes)) AS BIGINT) AS avg_bytes, CAST(sum(bytes) AS BIGINT) AS bytes FROM entity GROUP BY 1, 2")
def inventory_types(t: Tables) -> DataFrame:
    return profile.type_profile(t.entity)


@query("WITH {cte} SELECT site, type, status, count(*) AS n FROM entity GROUP BY ALL")
def inventory_status(t: Tables) -> DataFrame:
    return profile.status_profile(t.entity)


@query("WITH {cte} SELECT taxonomy, count(*) AS terms, bool_or(parent > 0) AS hierarchical FROM term GROUP BY 1")
def inventory_taxonomy(t: Tables) -> DataFrame:
    return profile.taxonomy_profile(t.term)


@query("WITH {cte} SELECT taxonomy, coalesce(e.type, '(missing)') AS type, count(*) AS n FROM relationship r JOIN term USING (term_id) LEFT JOIN entity e ON e.id = r.object_id AND e.status <> 'P' GROUP BY 1, 2")
def inventory_taxonomy_types(t: Tables) -> DataFrame:
    return profile.taxonomy_by_type(t.relationship, t.term, t.entity.where("status <> 'P'"))


@query("""WITH {cte} SELECT term_id, n, taxonomy, name, rn FROM (SELECT term_id, n, taxonomy, name, row_number() OVER (PARTITION BY taxonomy ORDER BY n DESC, name NULLS LAST, term_id) AS rn
FROM (SELECT term_id, count(*) AS n FROM relationship GROUP BY 1) JOIN term USING (term_id)) WHERE rn <= 5""")
def top5_terms(t: Tables) -> DataFrame:
    return profile.top_per_taxonomy(t.relationship, t.term)


@query("""WITH {cte}, m AS (SELECT post_id % 500 AS item, meta_key, ref_id FROM meta WHERE meta_key IN ('click', 'view', 'error')),
o AS (SELECT item, min(ref_id) AS v FROM m WHERE meta_key = 'click' GROUP BY 1), k AS (SELECT item, min(ref_id) AS v FROM m WHERE meta_key = 'view' GROUP BY 1), b AS (SELECT item, min(ref_id) AS v FROM m WHERE meta_key = 'error' GROUP BY 1)
SELECT t.taxonomy, count(DISTINCT t.term_id) AS n FROM o JOIN k USING (item) JOIN b USING (item) JOIN term t ON t.term_id = o.v WHERE k.v < 50 GROUP BY 1""")
def menu_terms_pivot(t: Tables) -> DataFrame:
    items = t.meta.select((F.col("post_id") % 500).alias("item"), "meta_key", "ref_id").groupBy("item").pivot("meta_key", ["click", "view", "error"]).agg(F.min("ref_id"))
    linked = items.where("click is not null and view < 50 and error is not null").select(F.col("click").alias("term_id"))
    return linked.join(t.term, "term_id").groupBy("taxonomy").agg(F.count_distinct("term_id").alias("n"))


@query("""WITH {cte} SELECT meta_key, count(*) AS refs, count(e.id) AS resolved FROM (SELECT meta_key, CASE WHEN meta_id % 3 = 0 THEN ref_id + 9000000 ELSE ref_id END AS ref_id FROM meta) m LEFT JOIN entity e ON e.id = m.ref_id
GROUP BY 1 HAVING count(e.id) > 0 ORDER BY refs DESC, meta_key LIMIT 3""")
def ref_resolution(t: Tables) -> DataFrame:
    own = t.meta.select("meta_key", F.when(F.col("meta_id") % 3 == 0, F.col("ref_id") + 9000000).otherwise(F.col("ref_id")).alias("ref_id"))
    return profile.reference_resolution(own, t.entity, 3)


@query("""SELECT regexp_replace(name, '[0-9][0-9.]*', '*', 'g') AS pattern, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
SELECT 'Supplier#' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '_1.5x' ELSE '' END AS name, s_suppkey * 1000 AS bytes FROM supplier) GROUP BY 1 HAVING sum(bytes) > 1000""")
def option_patterns(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    return profile.name_patterns(t.read("supplier").select(F.concat(F.lit("Supplier#"), key.cast("string"), F.when(key % 2 == 0, "_1.5x").otherwise("")).alias("name"), (key * 1000).alias("bytes")), 1000)


@query("WITH {cte} SELECT m.site, count(*) AS users, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(b) AS BIGINT) AS bytes FROM member m LEFT JOIN (SELECT author, count(*) AS n, sum(bytes) AS b FROM entity GROUP BY 1) ON author = m.id GROUP BY 1")
def site_rollup(t: Tables) -> DataFrame:
    own = t.entity.groupBy(F.col("author").alias("id")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    return t.user.join(own, "id", "left").groupBy("site").agg(F.count("*").alias("users"), F.sum("n").alias("rows"), F.sum("b").alias("bytes"))


# Checks -----------------------------------------------------------------------------------------------------------


@query("WITH {cte}, {keep} SELECT meta_id, post_id FROM meta m WHERE NOT EXISTS (SELECT 1 FROM keep k WHERE k.id = m.post_id)")
def orphans_anti(t: Tables) -> DataFrame:
    return checks.orphans(t.meta.select("meta_id", "post_id"), "post_id", base_keep(t), "id").select("meta_id", "post_id")


@query("""WITH {cte}, r AS (SELECT meta_key AS source, CASE WHEN meta_id % 5 = 0 THEN ref_id + 8000000 ELSE ref_id END AS ref_id FROM meta)
SELECT source, count(*) AS n FROM r WHERE ref_id > 0 AND NOT EXISTS (SELECT 1 FROM entity e WHERE e.id = r.ref_id) GROUP BY 1 ORDER BY n DESC, source LIMIT 5""")
def never_in_dump(t: Tables) -> DataFrame:
    own = t.meta.select(F.col("meta_key").alias("source"), F.when(F.col("meta_id") % 5 == 0, F.col("ref_id") + 8000000).otherwise(F.col("ref_id")).alias("ref_id"))
    return checks.never_in_source(own, t.entity)


@query("WITH {cte} SELECT id, author FROM entity WHERE author > 0 AND author NOT IN (SELECT id FROM member WHERE role <> 'BUILDING')")
def authors_missing(t: Tables) -> DataFrame:
    return checks.authors_missing(t.entity, t.user.where("role <> 'BUILDING'")).select("id", "author")


@query("""WITH {cte}, {keep}, targets AS (SELECT DISTINCT CAST(v AS BIGINT) AS id FROM (SELECT CASE WHEN meta_id % 4 = 0 THEN '9' || meta_id || '000000' WHEN meta_id % 4 = 1 THEN '0' ELSE CAST(ref_id AS VARCHAR) END AS v FROM meta WHERE meta_key = 'view') WHERE regexp_full_match(v, '[0-9]{1,18}') AND CAST(v AS BIGINT) > 0)
SELECT count(*) FILTER (WHERE e.id IS NOT NULL) AS in_source, count(*) FILTER (WHERE e.id IS NULL) AS never FROM targets t LEFT JOIN entity e ON e.id = t.id WHERE t.id NOT IN (SELECT id FROM keep)""")
def missing_targets(t: Tables) -> DataFrame:
    i = F.col("meta_id")
    own = t.meta.select("meta_key", F.when(i % 4 == 0, F.concat(F.lit("9"), i.cast("string"), F.lit("000000"))).when(i % 4 == 1, "0").otherwise(F.col("ref_id").cast("string")).alias("value"))
    return checks.missing_targets(own, "view", base_keep(t), t.entity)


@query("""WITH {cte}, {keep}, s AS (SELECT term_id, count(*) AS n FROM relationship GROUP BY 1 HAVING count(*) > 10), k AS (SELECT term_id, count(*) AS kept FROM relationship JOIN keep ON id = object_id GROUP BY 1)
SELECT taxonomy, term_id, n, coalesce(kept, 0) AS kept FROM s LEFT JOIN k USING (term_id) JOIN term USING (term_id) WHERE coalesce(kept, 0) <= 10""")
def second_page(t: Tables) -> DataFrame:
    return checks.second_page(t.relationship, base_keep(t), t.term, 10)


@query("""WITH {cte}, c AS (SELECT term_id, count(*) AS n FROM relationship JOIN entity e ON e.id = object_id WHERE e.status = 'F' GROUP BY 1)
SELECT t.term_id, t.taxonomy, t.name, t.parent, coalesce(n, 0) AS n FROM term t LEFT JOIN c USING (term_id)""")
def recount_terms(t: Tables) -> DataFrame:
    return finish.recount(t.term, t.relationship, t.entity.where("status = 'F'"))


EMAIL_SQL = "regexp_matches(text, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(\\.[A-Za-z0-9-]{1,63}){0,8}\\.[A-Za-z]{2,24}')"


@query(f"SELECT doc_id FROM documents WHERE text LIKE '%@%' AND {EMAIL_SQL}")
def pii_email_docs(t: Tables) -> DataFrame:
    return t.read("documents").where(checks.email_inside(F.col("text"))).select("doc_id")


@query("""SELECT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}(?:\\.[0-9]{1,3}){3}')) AS word FROM documents)
WHERE word NOT IN ('127.0.0.1', '0.0.0.0') AND NOT (starts_with(word, '192.0.2.') OR starts_with(word, '198.51.100.') OR starts_with(word, '203.0.113.'))""")
def pii_ip_docs(t: Tables) -> DataFrame:
    words = t.read("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), 0)).alias("word"))
    return words.where(checks.ip_not_allowed(F.col("word")))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,200}')) AS v FROM documents)
SELECT count(*) AS n, count(*) FILTER (WHERE lower(string_split(v, '@')[-1]) NOT IN ('example.com', 'example.org', 'example.net')) AS not_allowed FROM w""")
def pii_email_domains(t: Tables) -> DataFrame:
    words = t.read("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,200}"), 0)).alias("v"))
    return words.agg(F.count("*").alias("n"), F.count_if(checks.email_not_allowed(F.col("v"))).alias("not_allowed"))


@query(f"""SELECT label, n FROM (SELECT 'documents.email' AS label, count(*) FILTER (WHERE text LIKE '%@%' AND {EMAIL_SQL}) AS n FROM documents
UNION ALL SELECT 'documents.long', count(*) FILTER (WHERE length(text) > 5000) FROM documents UNION ALL SELECT 'documents.none', count(*) FILTER (WHERE length(text) < 0) FROM documents) WHERE n > 0""")
def pii_breakdown(t: Tables) -> DataFrame:
    text = F.col("text")
    return checks.breakdown(t.read("documents"), {"documents.email": checks.email_inside(text), "documents.long": F.length(text) > 5000, "documents.none": F.length(text) < 0})


@query("""SELECT doc_id, regexp_replace(array_to_string(list_transform(x, lambda v, i: CASE WHEN i % 2 = 0 AND i < len(x) AND NOT regexp_full_match(v, '[A-Za-z0-9_$.-]{1,64}') THEN '…' ELSE v END), ''''),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g') AS text FROM (SELECT doc_id, string_split(text, '''') AS x FROM documents)""")
def redact_docs(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", finish.redact("text").alias("text"))


# Copies -----------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, replace(replace(replace(replace(url, '//blog.thtion.example.com', '//localhost/blog'), '\\/\\/blog.thtion.example.com', '\\/\\/localhost\\/blog'), '//m.', '//localhost/m-'), '\\/\\/m.', '\\/\\/localhost\\/m-') AS url FROM pages""")
def localise_urls(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", finish.localise(F.col("url"), [("m.", "localhost/m-"), ("blog.thtion.example.com", "localhost/blog")]).alias("url"))


@query("""SELECT c_custkey AS id, 'user_' || substr(sha256('pepper:' || c_custkey), 1, 12) AS login, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey || '@example.org' ELSE 'user_' || substr(sha256('pepper:' || c_custkey), 1, 12) || '@example.com' END AS email,
'Name ' || substr(sha256('pepper:' || c_custkey), 1, 12) AS name, '' AS password FROM customer""")
def scrub_users(t: Tables) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    own = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("login"), F.concat(F.lit("c"), key, F.when(F.col("c_custkey") % 2 == 0, "@example.org").otherwise("@corp.test")).alias("email"), F.col("c_name").alias("name"), F.lit("secret").alias("password"))
    return finish.scrub_users(own, "pepper", allowed_domains=("example.org",))


@query("""WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS prefix FROM part UNION SELECT DISTINCT substr(p_name, 1, 7) FROM part)
SELECT p_partkey, p_name, (SELECT prefix FROM p WHERE starts_with(p_name, prefix) ORDER BY length(prefix) DESC LIMIT 1) AS prefix FROM part""")
def prefix_match_longest(t: Tables) -> DataFrame:
    part = t.read("part")
    prefixes = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("prefix")).union(part.select(F.substring("p_name", 1, 7).alias("prefix"))).distinct()
    return match.longest_prefix(part.select("p_partkey", "p_name"), "p_name", prefixes)


@query("""WITH k AS (SELECT p_partkey, replace(p_name, ' ', '_') AS key FROM part), n AS (SELECT split_part(p_name, ' ', 2) AS name, min(p_partkey) AS rank FROM part GROUP BY 1)
SELECT p_partkey, key, (SELECT name FROM n WHERE key = name OR ends_with(key, '_' || name) ORDER BY rank, name LIMIT 1) AS name FROM k""")
def suffix_match(t: Tables) -> DataFrame:
    part = t.read("part")
    names = part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).agg(F.min("p_partkey").alias("rank"))
    return match.first_suffix(part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("key")), "key", names)


@query("""WITH o AS (SELECT c_custkey AS option_id, CASE WHEN c_custkey % 2 = 0 THEN 'page_on_front' ELSE 'other' END AS name, CAST(c_custkey * 10 AS VARCHAR) AS value FROM customer), {cte}, {keep}
SELECT option_id, name, CASE WHEN name = 'page_on_front' AND CAST(value AS BIGINT) > 0 AND CAST(value AS BIGINT) NOT IN (SELECT id FROM keep) THEN '0' ELSE value END AS value FROM o""")
def fix_options(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    own = t.read("customer").select(key.alias("option_id"), F.when(key % 2 == 0, "page_on_front").otherwise("other").alias("name"), (key * 10).cast("string").alias("value"))
    return finish.cleared_options(own, ("page_on_front",), base_keep(t))


# Dumps and serialised values --------------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def dump_roundtrip(t: Tables) -> DataFrame:
    """Read by the data source, with columns and types picked by its schema."""
    path = _written(t, dump.to_dump(t.read("supplier").orderBy("s_suppkey"), "supplier"))
    return sqldump.rows(t.spark, path, "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double").withColumn("s_nationkey", F.col("s_nationkey").cast("int"))


@query("SELECT doc_id, text FROM documents")
def dump_text_roundtrip(t: Tables) -> DataFrame:
    statements = _dump(t, t.read("documents").select("doc_id", "text"), "documents")
    rows = dump.named_values(dump.read_rows(statements), statements, ("doc_id", "text"))
    return rows.select(F.col("values")["doc_id"].cast("bigint").alias("doc_id"), F.col("values")["text"].alias("text"))


@query("SELECT 'insert' AS kind, 'orders' AS tbl, count(*) AS rows FROM orders")
def dump_regroup(t: Tables) -> DataFrame:
    """Rows packed into statements of at most 4 KB, written, read again and counted."""
    first = dump.read_rows(_dump(t, t.read("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "orders"))
    packed = dump.insert_statements(first, 4096).select(F.regexp_replace(F.decode("raw", "UTF-8"), r";\n$", "").alias("value"))
    again = dump.read_statements(t.spark, _written(t, packed))
    return dump.read_rows(again).join(again.select("ord", "kind"), "ord").groupBy("kind", "tbl").agg(F.count("*").alias("rows"))


def _written(t: Tables, lines: DataFrame) -> str:
    path = f"{store.shared(t.spark)}/dump-{uuid.uuid4().hex}"
    lines.write.option("lineSep", ";\n").text(path)
    return path


def _dump(t: Tables, df: DataFrame, tbl: str) -> DataFrame:
    return dump.read_statements(t.spark, _written(t, dump.to_dump(df, tbl)))


@query("SELECT doc_id, text || ';' || chr(10) || chr(13) || chr(10) || '-- ' AS text FROM documents")
def dump_bytes(t: Tables) -> DataFrame:
    """Texts with line breaks and statement ends of all kinds within their strings, read in splits."""
    own = t.read("documents").select("doc_id", F.concat("text", F.lit(";\n\r\n-- ")).alias("text"))
    return sqldump.rows(t.spark, _written(t, dump.to_dump(own, "documents", 50, breaks=True)), "doc_id bigint, text string")


@query("""WITH g AS (SELECT count(*) AS n, sum(octet_length(encode('(' || c_custkey || ',''' || c_name || ''')'))) AS b FROM customer), w AS (SELECT count(*) AS n, sum(octet_length(encode('(' || s_suppkey || ')'))) AS b FROM supplier)
SELECT 'customer' AS tbl, g.n + w.n AS statements, g.n + w.n AS rows, w.n AS bad_rows, g.b + w.b AS row_bytes, (g.n + w.n) * length('INSERT INTO `customer` (`c_custkey`, `c_name`) VALUES ;.') AS other_bytes FROM g, w
UNION ALL SELECT 'part', 1, 0, 0, 0, length('DROP TABLE `part`;.') UNION ALL SELECT '', count(*), 0, 0, 0, count(*) * length('SET @a = 1;.') FROM nation""")
def dump_statistics(t: Tables) -> DataFrame:
    """Customers one a statement, suppliers as rows that lack a value, and statements of a table and of none, counted in one reading."""
    good = dump.to_dump(t.read("customer").select("c_custkey", "c_name"), "customer", 1)
    bad = t.read("supplier").select(F.concat(F.lit("INSERT INTO `customer` (`c_custkey`, `c_name`) VALUES ("), F.col("s_suppkey").cast("string"), F.lit(")")).alias("value"))
    other = t.read("region").where("r_regionkey = 0").select(F.lit("DROP TABLE `part`").alias("value")).unionByName(t.read("nation").select(F.lit("SET @a = 1").alias("value")))
    return sqldump.statistics(t.spark, _written(t, good.unionByName(bad).unionByName(other)))


@query("""WITH k AS (SELECT o_orderkey AS id, o_custkey AS author FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50),
c AS (SELECT l_partkey AS term, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN k ON id = l_orderkey GROUP BY 1), u AS (SELECT c_custkey AS id, 'user_' || substr(sha256('pepper:' || c_custkey), 1, 12) AS who FROM customer WHERE c_custkey IN (SELECT author FROM k))
SELECT 'login' AS kind, id, who AS value FROM u UNION ALL SELECT 'email', id, CASE WHEN id % 2 = 0 THEN 'c' || id || '@example.org' ELSE who || '@example.com' END FROM u
UNION ALL SELECT 'count', p_partkey, CAST(coalesce(n, 0) AS VARCHAR) FROM part LEFT JOIN c ON term = p_partkey WHERE n IS NOT NULL OR (SELECT count(*) FROM part) <= 500""")
def finish_copy(t: Tables) -> DataFrame:
    """Orders as posts, customers as users and parts as terms in a dump; the copy's users and counts after the last steps."""
    nothing = F.lit("")
    key = F.col("c_custkey")
    parts = {
        "wp_posts": t.read("orders").select(F.col("o_orderkey").alias("ID"), F.col("o_custkey").alias("post_author"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("post_date"), nothing.alias("post_content"), F.when(F.col("o_orderstatus") == "F", "publish").otherwise("draft").alias("post_status"), F.lit(0).alias("post_parent"), F.lit("post").alias("post_type")),
        "wp_users": t.read("customer").select(key.alias("ID"), F.col("c_name").alias("user_login"), F.concat(F.lit("c"), key.cast("string"), F.when(key % 2 == 0, "@example.org").otherwise("@corp.test")).alias("user_email"), F.lit("secret").alias("user_pass")),
        "wp_term_taxonomy": t.read("part").select(F.col("p_partkey").alias("term_taxonomy_id"), F.col("p_partkey").alias("term_id"), F.lit("post_tag").alias("taxonomy"), F.lit(0).alias("parent"), F.lit(7).alias("count")),
        "wp_term_relationships": t.relationship.select("object_id", F.col("term_id").alias("term_taxonomy_id"), F.lit(0).alias("term_order")),
        "wp_options": t.read("region").where("r_regionkey = 0").select(F.lit(1).alias("option_id"), F.lit("siteurl").alias("option_name"), F.lit("https://a.example.org").alias("option_value"), F.lit("yes").alias("autoload")),
    }
    every = [dump.to_dump(df, name) for name, df in parts.items()]
    index = subset.build_index(t.spark, _written(t, reduce(DataFrame.unionByName, every)))
    settings = config.load("post_types: {post: {mode: latest, count: 50}}")
    plan = subset.make_plan(index, settings)
    rows = finishing.finished(index, plan, subset.slim(index, plan), settings, "pepper")
    named = sqldump.parsed(rows, sqldump.declared_of(index.others), "_tbl string, id string, user_login string, user_email string, term_taxonomy_id string, count string").where("_tbl in ('wp_users', 'wp_term_taxonomy')")
    made = F.when(F.col("_tbl") == "wp_users", F.array(F.struct(F.lit("login").alias("kind"), "id", F.col("user_login").alias("value")), F.struct(F.lit("email").alias("kind"), "id", F.col("user_email").alias("value"))))
    made = made.otherwise(F.array(F.struct(F.lit("count").alias("kind"), F.col("term_taxonomy_id").alias("id"), F.col("count").alias("value"))))
    return named.select(F.explode(made).alias("x")).select("x.kind", F.col("x.id").cast("bigint").alias("id"), "x.value")


@query("SELECT event_id, unnest([event_id + 1, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1, 7]) AS ref_id FROM events")
def php_roundtrip(t: Tables) -> DataFrame:
    """Ids serialised in the query, one as a string, and decoded again."""
    e = t.meta.select(F.col("post_id").alias("event_id"), (F.col("post_id") + 1).cast("string").alias("a"), (F.col("ref_id") + 1).cast("string").alias("b"))
    text = F.concat(F.lit("a:3:{i:0;i:"), "a", F.lit(';s:1:"k";s:'), F.length("b").cast("string"), F.lit(':"'), "b", F.lit('";i:2;a:1:{i:0;i:7;}}'))
    return e.select("event_id", F.explode(php.php_ids(text)).alias("ref_id"))


@query("""SELECT page_id AS id, CAST(k AS BIGINT) AS ref_id, source FROM (SELECT page_id, unnest([page_id + 1, page_id + 2, page_id + 3, page_id + 2]) AS k, unnest(['block:core/image:id', 'class:wp-image', 'shortcode:gallery', 'shortcode:gallery']) AS source FROM pages)""")
def content_refs(t: Tables) -> DataFrame:
    """Block, image and gallery references put around each page's text and found again, each once a source."""
    n = [(F.col("page_id") + i).cast("string") for i in (1, 2, 3)]
    text = F.concat(F.lit('<!-- wp:image {"id":'), n[0], F.lit(',"x":{"y":1}} -->'), "html", F.lit('<img class="wp-image-'), n[1], F.lit('"> [gallery ids="'), n[2], F.lit(", "), n[1], F.lit('"]'))
    return refs.content_refs(t.read("pages").select(F.col("page_id").alias("id"), text.alias("text")), "id", "text")


@query("""SELECT page_id, 's:' || octet_length(encode(replace(url, '//', '//localhost/'))) || ':"' || replace(url, '//', '//localhost/') || '";' AS value FROM pages""")
def localise_serialised(t: Tables) -> DataFrame:
    """URLs replaced inside serialised strings, whose lengths follow."""
    url = F.col("url")
    text = F.concat(F.lit("s:"), F.octet_length(url).cast("string"), F.lit(':"'), url, F.lit('";'))
    return t.read("pages").select("page_id", php.php_replace(text, [("//", "//localhost/")]).alias("value"))
