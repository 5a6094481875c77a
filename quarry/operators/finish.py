"""The last steps on a copy: scrub, recount, repair, local URLs."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host labels that name an environment.
ENVIRONMENTS = ("www", "stage", "staging", "dev", "develop", "development", "test", "qa", "uat", "preprod", "prod", "vip", "local")


def pseudonym(column: Column, salt: str, prefix: str) -> Column:
    """A stable stand-in that tells nothing of the value without the salt."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), column.cast("string")), 256), 1, 12))


def scrub_users(user: DataFrame, salt: str, allowed_domains: tuple[str, ...] = (), allowed_emails: tuple[str, ...] = ()) -> DataFrame:
    """user (id, login, email, name, password, url, activation_key) with logins, names and addresses replaced and secrets emptied; allowed addresses stay."""
    allowed = F.lit(False)
    if allowed_domains:
        allowed = allowed | F.lower(F.substring_index("email", "@", -1)).isin(*[d.lower() for d in allowed_domains])
    if allowed_emails:
        allowed = allowed | F.lower("email").isin(*[e.lower() for e in allowed_emails])
    login = pseudonym(F.col("id"), salt, "user_")
    changed = {"login": login, "email": F.when(allowed, F.col("email")).otherwise(F.concat(login, F.lit("@example.com"))), "name": pseudonym(F.col("id"), salt, "Name "), "password": F.lit(""), "url": F.lit(""), "activation_key": F.lit("")}
    return user.withColumns({c: v for c, v in changed.items() if c in user.columns})


def redact(column: Column | str) -> Column:
    """Quoted values that are no identifiers of 1 to 64 letters as '…', and addresses as <email>. A quote without an end quotes nothing."""
    parts = F.split(column, "'")
    last = F.size(parts) - 1
    kept = F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < last) & ~x.rlike("^[A-Za-z0-9_$.-]{1,64}$"), F.lit("…")).otherwise(x))
    return F.regexp_replace(F.array_join(kept, "'"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")


def recount(term: DataFrame, relationship: DataFrame, counted: DataFrame, key: str = "term_id", scope: tuple[str, ...] = ()) -> DataFrame:
    """Terms with n, the number of their relationships with entities that count (id); 0 where there is none. `scope` as in `keep`."""
    n = relationship.join(counted.select(*scope, F.col("id").alias("object_id")), [*scope, "object_id"], "left_semi").groupBy(*scope, key).agg(F.count("*").alias("n"))
    return term.join(n, [*scope, key], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cleared_options(options: DataFrame, names: tuple[str, ...], kept: DataFrame) -> DataFrame:
    """Options that hold the id of a row that is gone get 0."""
    from quarry.functions.ids import parse_id

    own = options.withColumn("__id", F.when(F.col("name").isin(*names), parse_id("value")))
    there = kept.select(F.col("id").alias("__id")).distinct().withColumn("__there", F.lit(True))
    return own.join(there, "__id", "left").withColumn("value", F.when(F.col("__id").isNotNull() & F.col("__there").isNull(), F.lit("0")).otherwise(F.col("value"))).select(*options.columns)


def localise(column: Column, pairs: list[tuple[str, str]]) -> Column:
    """`column` with each //from replaced by //to, plain and as JSON escapes it, the longest first."""
    for old, new in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
        column = F.replace(column, F.lit("//" + old), F.lit("//" + new))
        column = F.replace(column, F.lit("\\/\\/" + old.replace("/", "\\/")), F.lit("\\/\\/" + new.replace("/", "\\/")))
    return column


def slug(domain: str) -> str:
    """The first label that names no environment and is not the last; else site."""
    labels = domain.lower().split(".")
    return next((re.sub(r"[^a-z0-9-]+", "-", x).strip("-") or "site" for x in labels[:-1] if x not in ENVIRONMENTS), "site")


def local_address(url: str) -> str:
    """Host and path of a local URL. It needs a scheme and a host, and has neither query nor fragment."""
    parts = urlsplit(url.strip())
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError(f"{url!r} is no URL such as https://news.local")
    if parts.query or parts.fragment:
        raise ValueError(f"{url!r} has a query or a fragment")
    return (parts.netloc + parts.path).strip("/")


def targets(sites: list[tuple[int, str, str]], local: str, overrides: dict[int, str] | None = None) -> dict[int, str]:
    """The local host and path of each site (id, domain, path): the main one itself, others under their path or slug; a name taken twice gets the id."""
    overrides, out, taken = overrides or {}, {}, set()
    base = local_address(local)
    main = sites[0][1] if sites else ""
    for number, (site, domain, path) in enumerate(sites):
        tail = path.strip("/")
        if site in overrides:
            found = local_address(overrides[site])
            if found in taken:
                raise ValueError(f"site {site}: {found} is taken")
        elif number == 0:
            found = base
        else:
            name = tail if domain == main and tail else slug(domain)
            found = f"{base}/{name}"
            if found in taken:
                found = f"{found}-{site}"
        taken.add(found)
        out[site] = found
    return out


def replacements(sites: list[tuple[int, str, str]], to: dict[int, str]) -> list[tuple[str, str]]:
    """(from, to) without schemes; equal ends are left out, and one start with two ends is an error."""
    found: dict[str, str] = {}
    for site, domain, path in sites:
        old = (domain + "/" + path.strip("/")).strip("/")
        if old == to[site]:
            continue
        if found.setdefault(old, to[site]) != to[site]:
            raise ValueError(f"{old} would become both {found[old]} and {to[site]}")
    return sorted(found.items(), key=lambda p: (-len(p[0]), p[0]))
