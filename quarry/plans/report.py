"""A plan as plain data: tables with rules and sizes, types, sites, reasons, warnings, and the estimated size of the copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.ids import format_bytes
from quarry.operators import profile, seeds
from quarry.sources.config import ALL, ALWAYS_DROPPED, Config

from .rules import REBUILD
from .subset import FOLLOWED, Index, Plan, filtered_rows

#: Bytes that a table takes beside its rows and definition, and a dump beside its tables.
PER_TABLE, PER_DUMP = 400, 2048


def table_sizes(index: Index, plan: Plan) -> list[dict]:
    """Per table: rule, rows and bytes that are kept, and whether these are exact."""
    core = {r.tbl: r for r in _by_table(plan)}
    kept = filtered_rows(index, plan).groupBy("tbl").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    core |= {r.tbl: r for r in kept.collect()}
    out = []
    for t in index.tables.orderBy("tbl").collect():  # a row per table
        rule = plan.rules[t.tbl]
        n, size = (t.rows, t.row_bytes) if rule.action == "keep" or t.role == "links" else (core[t.tbl].n, core[t.tbl].bytes) if t.tbl in core and rule.action in ("core", "filter") else (0, 0)
        fixed = 0 if rule.action == "drop" else len((t.create_sql or "").encode()) + PER_TABLE
        out.append({"table": t.tbl, "site": t.site, "action": rule.action, "source": rule.source, "note": rule.note, "rows": n, "of_rows": t.rows, "bytes": size + fixed})
    return out


def _by_table(plan: Plan) -> list:
    parts = [rows.groupBy("tbl").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")) for rows in plan.kept.values()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.collect()


def page_sizes(index: Index) -> dict[int, int]:
    """Posts on a page of each site that says so: the largest number of its rows of that option."""
    own = index.options.where(F.col("name") == "posts_per_page").groupBy("site").agg(F.max(F.trim("value").try_cast("bigint")).alias("n"))
    return {r.site: r.n for r in own.collect() if r.n}  # a row per site


def warnings(index: Index, plan: Plan, config: Config, total: int, tables: list[dict]) -> list[str]:
    """What a reader of the plan should look at."""
    out = list(plan.warnings)
    sites = set(index.sites)
    out += [f"sites.{key}: no such site" for key in config.sites if key != "*" and int(key) not in sites]
    kinds = {r.type for r in index.posts.select("type").distinct().collect()}
    configured = set(config.post_types) | {k for own in config.sites.values() for k in own.get("post_types", {})}
    out += [f"post_types.{k}: no post is of this type" for k in sorted(configured - kinds)]
    by_default = sorted(k for k in kinds - configured if k and k not in ALWAYS_DROPPED and k != "attachment")
    out += [f"{k}: not configured, newest {config.default_post_type.count} kept" for k in by_default]
    used = {r.meta_key for r in index.meta_refs.select("meta_key").distinct().where(F.col("meta_key").isin(*(config.extra_meta_keys or ("",)))).collect()}
    out += [f"references.extra_meta_keys: {k} holds no ids" for k in config.extra_meta_keys if k not in used and k not in FOLLOWED]
    pages = page_sizes(index)
    for site in sorted(plan.included):
        page = pages.get(site)
        own = config.for_site(site).post_types
        out += [f"site {site}: post_types.{k}: per_term of {t.per_term} leaves no second page of {page}" for k, t in sorted(own.items()) if page and t.mode == "per_term" and t.per_term <= page]
    big = profile.name_patterns(plan.kept["options"].select("name", "bytes"), 1 << 20).orderBy(F.col("bytes").desc(), "pattern").collect()
    out += [f"options like {r.pattern}: {r.n} of {format_bytes(r.bytes)}" for r in big]
    if total > config.target_size_mb * (1 << 20):
        biggest = ", ".join(f"{t['table']} {format_bytes(t['bytes'])}" for t in sorted(tables, key=lambda t: (-t["bytes"], t["table"]))[:3])
        out.append(f"{format_bytes(total)} is over the target of {config.target_size_mb} MB; biggest tables: {biggest}")
    return out


def described(config: Config, kind: str) -> dict:
    """What the configuration says of a type, in words."""
    rule = config.post_types.get(kind, config.default_post_type)
    taxonomies = ", ".join(sorted(rule.taxonomies))
    mode = f"latest {rule.count}" if rule.mode == "latest" else f"{rule.per_term} per term of {taxonomies}" if rule.mode == "per_term" else rule.mode
    return {"mode": mode, "statuses": ", ".join(s if n == ALL else f"{s} +{n}" for s, n in sorted(rule.statuses.items()) if n == ALL or n > 0)}


def report(index: Index, plan: Plan, config: Config) -> dict:
    """All of it, ready for JSON."""
    tables = table_sizes(index, plan)
    total = sum(t["bytes"] for t in tables) + PER_DUMP
    posts = seeds.drop_filter(index.posts, ALWAYS_DROPPED)
    types = profile.type_report(posts, plan.keep, index.postmeta).orderBy("site", "type").collect()
    by_site: dict[int, int] = {}
    for t in tables:
        by_site[t["site"]] = by_site.get(t["site"], 0) + t["bytes"]
    posts_of, kept_of = ({r.site: r["count"] for r in df.groupBy("site").count().collect()} for df in (index.posts, plan.keep))  # a row per site
    return {
        "sites": [
            {"site": r.site, "prefix": r.prefix, "domain": r.domain, "path": r.path, "bytes": by_site.get(r.site, 0), "posts": posts_of.get(r.site, 0), "kept_posts": kept_of.get(r.site, 0), "has_tables": r.has_tables, "excluded": r.site not in plan.included}
            for r in index.frames["sites"].orderBy("site").collect()  # a row per site
        ],
        "types": [r.asDict() | described(config.for_site(r.site), r.type) for r in types],
        "added": [r.asDict() for r in profile.added_by_reason(plan.keep).orderBy("site", F.col("n").desc(), "reason").collect()],
        "tables": tables,
        "bytes": total,
        "warnings": warnings(index, plan, config, total, tables),
        "after_import": sorted({t["note"].removeprefix(REBUILD + ": ") for t in tables if t["action"] == "empty" and t["of_rows"] and t["note"].startswith(REBUILD + ": ")}),
    }
