"""The last steps on a copy's rows, before it is checked and written: scrub, repair, recount, localise.

Rows are those of `subset.slim`; rows that change get a new body, all others keep their bytes. What depends on other rows
(counts, options that name posts) is worked out by joins and comes to the rows as edits; what depends on the row alone is
done where the row is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import php
from quarry.operators import checks, closure, finish
from quarry.sources import dump
from quarry.sources.config import Config

from .subset import OPTION_REFS, Index, Plan
from .validate import Check

#: The stand-in address, options that hold an administrator's, and types whose terms count whatever the status.
ADMIN_EMAIL = "admin@example.com"
ADMIN_OPTIONS = ("admin_email", "new_admin_email")
GENERIC_TYPES = ("nav_menu_item", "wp_template", "wp_template_part", "wp_navigation", "wp_global_styles", "wp_block")
#: Keys of user meta that tell who someone is: names get a stand-in, all others nothing.
NAME_META = ("nickname", "first_name", "last_name")
EMPTIED_META = ("description", "session_tokens", "community-events-location")
EMPTIED_META_STARTS = ("billing_", "shipping_")


def counts(index: Index, plan: Plan) -> DataFrame:
    """(tbl, site, term_taxonomy_id, n): each kept term's posts that count, of taxonomies that have nothing but kept posts."""
    posts = plan.kept["posts"].select("site", "id", "type", "status")
    terms = plan.kept["term_taxonomy"].where("taxonomy <> 'link_category'").select("tbl", "site", "term_taxonomy_id", "taxonomy")
    placed = plan.kept["term_relationships"].select("site", "object_id", "term_taxonomy_id")
    other = placed.join(posts.select("site", F.col("id").alias("object_id")), ["site", "object_id"], "left_anti").join(terms.drop("tbl"), ["site", "term_taxonomy_id"]).select("site", "taxonomy").distinct()
    counted = posts.where((F.col("status") == "publish") | ((F.col("type") == "attachment") & (F.col("status") == "inherit")) | F.col("type").isin(*GENERIC_TYPES))
    return finish.recount(terms.join(other, ["site", "taxonomy"], "left_anti"), placed, counted, "term_taxonomy_id", ("site",)).select("tbl", "site", "term_taxonomy_id", "n")


def lost_pages(index: Index, plan: Plan) -> DataFrame:
    """(tbl, site, option_id, name, value): options that name posts of which the copy has none, with what they get."""
    posts = plan.kept["posts"].select("site", F.col("id").alias("ref")).distinct()
    options = plan.kept["options"]
    single = options.where(F.col("name").isin(*OPTION_REFS) & F.col("value").rlike("^[0-9]+$")).select("tbl", "site", "option_id", "name", F.col("value").try_cast("bigint").alias("ref")).where("ref <> 0 or ref is null")
    single = single.join(posts, ["site", "ref"], "left_anti").select("tbl", "site", "option_id", "name", F.lit("0").alias("value"))
    sticky = F.udf(lambda x: php.ids_in(x, ints_only=True), "array<bigint>")  # one row per site
    ids = options.where("name = 'sticky_posts'").select("tbl", "site", "option_id", "name", F.posexplode(sticky("value")).alias("at", "ref")).join(posts.withColumn("there", F.lit(True)), ["site", "ref"], "left")
    left = ids.groupBy("tbl", "site", "option_id", "name").agg(F.count_if(F.col("there").isNull()).alias("lost"), F.sort_array(F.collect_list(F.when(F.col("there"), F.struct("at", "ref")))).alias("own")).where("lost > 0")
    packed = F.concat(F.lit("a:"), F.size("own").cast("string"), F.lit(":{"), F.array_join(F.transform("own", lambda x, i: F.concat(F.lit("i:"), i.cast("string"), F.lit(";i:"), x["ref"].cast("string"), F.lit(";"))), ""), F.lit("}"))
    return single.unionByName(left.select("tbl", "site", "option_id", "name", packed.alias("value")))


def edits(index: Index, plan: Plan) -> DataFrame:
    """(ord, row, edits map<string,string>): new values of columns by lower-case name."""
    named = index.named
    of_terms = named.where("role = 'term_taxonomy'").select("ord", "row", "tbl", F.col("v_term_taxonomy_id").try_cast("bigint").alias("term_taxonomy_id"))
    of_terms = of_terms.join(counts(index, plan), ["tbl", "term_taxonomy_id"]).select("ord", "row", F.create_map(F.lit("count"), F.col("n").cast("string")).alias("edits"))
    of_options = named.where("role = 'options'").select("ord", "row", "tbl", F.col("v_option_id").try_cast("bigint").alias("option_id"))
    of_options = of_options.join(lost_pages(index, plan), ["tbl", "option_id"]).select("ord", "row", F.create_map(F.lit("option_value"), "value").alias("edits"))
    return of_terms.unionByName(of_options)


def stand_in(salt: str, value: str) -> str:
    return "user_" + hashlib.sha256(f"{salt}:{value}".encode()).hexdigest()[:12]


def scrubbed(role: str, own: dict[str, str | None], salt: str, domains: tuple[str, ...], emails: tuple[str, ...]) -> dict[str, str] | None:
    """New values of a row's columns (own, by lower-case name); None: the row goes."""
    low = tuple(d.lower() for d in domains)

    def address(name: str, who: str) -> str:
        value = own.get(name) or ""
        stays = not value or value.lower() in emails or value.lower().rpartition("@")[2] in low
        return value if stays else who + "@example.com"

    if role == "users":
        who = stand_in(salt, own.get("id") or "")
        out = {"user_login": who, "user_nicename": who, "display_name": who, "user_pass": "", "user_url": "", "user_activation_key": "", "user_email": address("user_email", who)}
    elif role == "comments":
        who = stand_in(salt, (own.get("comment_author_email") or own.get("comment_author") or "").lower())
        out = {"comment_author": who, "comment_author_url": "", "comment_author_ip": "127.0.0.1", "comment_agent": "", "comment_author_email": address("comment_author_email", who)}
    elif role == "usermeta":
        key = own.get("meta_key") or ""
        if key in NAME_META:
            out = {"meta_value": stand_in(salt, own.get("user_id") or "")}
        elif key in EMPTIED_META or key.startswith(EMPTIED_META_STARTS):
            out = {"meta_value": ""}
        else:
            out = {}
    elif role == "options" and own.get("option_name") in ADMIN_OPTIONS:
        out = {"option_value": ADMIN_EMAIL}
    elif role == "sitemeta":
        key = own.get("meta_key") or ""
        if key.startswith("_site_transient_"):
            return None
        out = {"meta_value": ADMIN_EMAIL} if key in ADMIN_OPTIONS else {"meta_value": "a:0:{}"} if key == "site_admins" else {}
    else:
        out = {}
    return {k: v for k, v in out.items() if k in own and own[k] != v}


def addresses(index: Index, plan: Plan, config: Config) -> tuple[list[tuple[str, str]], dict[int, tuple[str, str]], str]:
    """(from, to) of all included sites, each site's local host and path, and the local scheme. None without local.url."""
    if not config.local_url:
        return [], {}, ""
    known = {r.site: r for r in index.blogs.where(F.col("blog_id").isin(*plan.included)).select(F.col("blog_id").alias("site"), "domain", "path").collect()} if "blogs" in index.frames else {}
    homes = {(r.site, r.name): (r.value or "").rstrip("/") for r in plan.kept["options"].where("name in ('home', 'siteurl')").select("site", "name", "value").collect()}  # two rows per site
    sites, more = [], []
    for site in sorted(plan.included):
        home = homes.get((site, "home")) or homes.get((site, "siteurl")) or ""
        parts = urlsplit(home)
        domain, path = (known[site].domain, known[site].path) if site in known else (parts.netloc, parts.path)
        if not domain:
            raise ValueError(f"site {site}: the address {home!r} can't be read")
        sites.append((site, domain, path))
        for name in ("home", "siteurl"):
            other = urlsplit(homes.get((site, name), ""))
            if other.netloc and other.netloc + other.path.rstrip("/") != (domain + "/" + path.strip("/")).rstrip("/"):
                more.append((site, other.netloc, other.path))
    to = finish.targets(sites, config.local_url, config.local_sites)
    pairs = dict(finish.replacements(sites, to))
    for old, new in finish.replacements(more, to):
        if not any(old == p or old.startswith(p + "/") for p in pairs):
            pairs[old] = new
    where = {site: (t.partition("/")[0], "/" + (t.partition("/")[2] + "/" if "/" in t else "")) for site, t in to.items()}
    return sorted(pairs.items(), key=lambda p: (-len(p[0]), p[0])), where, "https" if config.local_url.startswith("https://") else "http"


def swaps(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Each pair after //, plain and as JSON escapes it."""
    out = []
    for old, new in pairs:
        out += [("//" + old, "//" + new), ("\\/\\/" + old.replace("/", "\\/"), "\\/\\/" + new.replace("/", "\\/"))]
    return out


#: Roles whose rows a last step may change whatever they hold.
TOUCHED = ("users", "comments", "usermeta", "options", "sitemeta", "blogs", "site")


def finished(index: Index, plan: Plan, rows: DataFrame, config: Config, salt: str) -> DataFrame:
    """The rows with all last steps done. Values that can't be decoded stay as they are.

    Rows that no step can change pass as they are: those of other roles without edits and, where addresses change, without a //.
    """
    allowed, emails = checks.ALLOWED_DOMAINS + config.allowed_domains, tuple(e.lower() for e in config.allowed_emails)
    pairs, where, scheme = addresses(index, plan, config)
    exchange = swaps(pairs)
    main = where.get(1)

    def declare(create: str | None) -> list[str] | None:
        return [n for n, _ in dump.declared_columns(create.encode())] if create else None

    listed = [(t.tbl, t.site, t.role, declare(t.create_sql)) for t in index.tables.collect()]  # a row per table
    tables = index.tables.sparkSession.createDataFrame(listed, "tbl string, site int, role string, declared array<string>")
    names = ("ord", "row", "tbl", "columns", "body", "tail")
    given = closure.saved(rows.select(*names).join(edits(index, plan), ["ord", "row"], "left").join(F.broadcast(tables), "tbl", "left"))
    touched = F.coalesce(F.col("role"), F.lit("")).isin(*TOUCHED) | F.col("edits").isNotNull()
    if exchange:
        touched = touched | F.contains("body", F.lit(b"//")) | F.contains("body", F.lit(b"\\/"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                columns = r["columns"] or r["declared"] or []
                low = [c.lower() for c in columns]
                r["values"] = [{"kind": k, "raw": v} for k, v in dump.tuple_at(r["body"], 0)[0]]
                if len(low) != len(r["values"]):
                    out.append(r)
                    continue
                own = {c: (dump.decode(v["kind"], v["raw"]) or b"").decode("utf-8", "surrogateescape") if v["kind"] in ("string", "number", "hex") else None for c, v in zip(low, r["values"], strict=True)}
                new = scrubbed(r["role"] or "", own, salt, allowed, emails)
                if new is None:
                    continue
                new |= {k: v for k, v in r["edits"] or [] if own.get(k) != v}
                if exchange:
                    for c, v in zip(low, r["values"], strict=True):
                        if v["kind"] == "string" and c != "guid":
                            now = new.get(c, own[c])
                            then = php.replaced(now, exchange)
                            if then != now:
                                new[c] = then
                    if r["role"] == "options" and own.get("option_name") in ("home", "siteurl"):
                        now = new.get("option_value", own["option_value"]) or ""
                        host, path = where.get(r["site"], ("", ""))
                        if host and now.partition("://")[2].startswith((host + path).rstrip("/")):
                            new["option_value"] = scheme + "://" + now.partition("://")[2]
                    elif r["role"] == "blogs" and (own.get("blog_id") or "").isdigit() and int(own["blog_id"]) in where:
                        new["domain"], new["path"] = where[int(own["blog_id"])]
                    elif r["role"] == "site" and main:
                        new["domain"], new["path"] = main
                    elif r["role"] == "sitemeta" and main and own.get("meta_key") == "siteurl":
                        new["meta_value"] = f"{scheme}://{main[0]}{main[1]}"
                    elif r["role"] == "sitemeta" and main and own.get("meta_key") == "subdomain_install":
                        new["meta_value"] = str(int(any(host != main[0] for host, _ in where.values())))
                if new:
                    for i, c in enumerate(low):
                        if c in new:
                            number = r["values"][i]["kind"] == "number" and new[c].lstrip("-").isdigit()
                            r["values"][i] = {"kind": "number", "raw": new[c].encode()} if number else {"kind": "string", "raw": dump.quoted(new[c].encode("utf-8", "surrogateescape"))}
                    r["body"] = b"(" + b",".join(v["raw"] for v in r["values"]) + b")"
                out.append(r)
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema=layout)

    layout = pa.schema([("ord", pa.int64()), ("row", pa.int32()), ("tbl", pa.string()), ("columns", pa.list_(pa.string())), ("body", pa.binary()), ("tail", pa.binary())])
    changed = given.where(touched).mapInArrow(rewrite, "ord long, row int, tbl string, columns array<string>, body binary, tail binary")
    return given.where(~touched).select(*names).unionByName(changed)


def personal_data(copy: Index, config: Config) -> list[Check]:
    """Emails and addresses in columns named for them fail, emails within other texts warn; one pass over the copy's rows."""
    listed = [(t.tbl, [n for n, _ in dump.declared_columns(t.create_sql.encode())] if t.create_sql else None) for t in copy.tables.collect()]
    tables = copy.rows.sparkSession.createDataFrame(listed, "tbl string, declared array<string>")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tbl, columns, body in zip(*(batch.column(c).to_pylist() for c in ("tbl", "names", "body")), strict=True):
                values = dump.tuple_at(body, 0)[0]
                if columns and len(columns) == len(values):
                    for name, (kind, raw) in zip(columns, values, strict=True):
                        if kind in ("string", "hex"):
                            out.append((tbl, name.lower(), dump.decode(kind, raw).decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], ["tbl", "name", "value"])

    cells = copy.rows.join(F.broadcast(tables), "tbl", "left").select("tbl", F.coalesce("columns", "declared").alias("names"), "body").mapInArrow(flat, "tbl string, name string, value string").where("value <> ''")
    email, ip = F.col("name").contains("email"), F.col("name").rlike(checks.IP_COLUMN)
    bad = F.when(email, checks.email_not_allowed(F.col("value"), checks.ALLOWED_DOMAINS + config.allowed_domains, config.allowed_emails)).when(ip, checks.ip_not_allowed(F.col("value"))).otherwise(checks.email_inside(F.col("value")))
    kind = F.when(email, "emails").when(ip, "addresses").otherwise("content")
    found = cells.where(bad).groupBy(kind.alias("kind"), "tbl", "name").agg(F.count("*").alias("n")).collect()  # a row per column
    said = (("no email addresses outside the allowed patterns", "emails", checks.FAIL), ("no IP addresses outside the allowed ranges", "addresses", checks.FAIL), ("no email addresses in content", "content", checks.WARNING))
    out = []
    for title, label, status in said:
        own = [r for r in found if r.kind == label]
        out.append(Check(title, status if own else checks.PASS, sum(r.n for r in own), ", ".join(sorted(f"{r.tbl}.{r.name}" for r in own))))
    return out


def address_check(index: Index, plan: Plan, copy: Index, config: Config) -> list[Check]:
    """Whether each site's home is its local address; nothing without local.url."""
    _, where, scheme = addresses(index, plan, config)
    homes = {r.site: (r.value or "").rstrip("/") for r in copy.options.where("name = 'home'").select("site", "value").collect()} if where else {}
    wrong = [s for s, home in homes.items() if s in where and home != (f"{scheme}://" + "".join(where[s])).rstrip("/")]
    return [Check("site addresses are local", checks.FAIL if wrong else checks.PASS, len(wrong), ", ".join(f"site {s}" for s in sorted(wrong)))] if where else []


def page_check(index: Index, plan: Plan) -> list[Check]:
    """Options that name pages the copy does not have: a warning, they are reset."""
    n = lost_pages(index, plan).where("name <> 'sticky_posts'").count()
    return [Check("page options point at kept pages", checks.WARNING if n else checks.PASS, n, "these options named pages that are not there; they are reset to 0" if n else "")]
