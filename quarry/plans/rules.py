"""What happens to each table: kept, emptied, filtered, dropped, or cut to the keep set."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fnmatch import fnmatchcase

from quarry.sources.config import Config, ConfigError

#: Unknown tables below this size are kept whole.
SMALL = 1 << 20

REBUILD, PERSONAL, ADDRESSES = "rebuild after import", "personal data", "IP addresses"
#: What rebuilds an index table.
YOAST, PRODUCTS = REBUILD + ": wp yoast index", REBUILD + ": wp wc tool run regenerate_product_lookup_tables"
#: Rules for known plugin tables by glob of the name without prefix; the first that fits counts.
LIBRARY = (
    ("yoast_indexable", "empty", YOAST), ("yoast_indexable_hierarchy", "empty", YOAST), ("yoast_seo_links", "empty", YOAST), ("yoast_seo_meta", "empty", YOAST),
    ("yoast_primary_term", "empty", YOAST), ("yoast_migrations", "keep", "state of migrations"), ("wc_product_meta_lookup", "empty", PRODUCTS),
    ("wc_product_attributes_lookup", "empty", REBUILD), ("wc_category_lookup", "empty", REBUILD), ("wc_reserved_stock", "empty", ""),
    ("actionscheduler_*", "empty", ""), ("redirection_logs", "empty", ""), ("redirection_404", "empty", ""), ("wf*", "empty", ""), ("wfls_*", "empty", ""),
    ("stream", "empty", ""), ("jetpack_sync_queue", "empty", REBUILD), ("vip_search_index_queue", "empty", REBUILD), ("stream_meta", "empty", ""),
    ("wc_admin_notes", "empty", ""), ("wc_admin_note_actions", "empty", ""), ("wc_rate_limits", "empty", ""), ("wc_download_log", "empty", PERSONAL),
    ("woocommerce_sessions", "empty", PERSONAL), ("gf_form_view", "empty", ADDRESSES), ("wc_orders", "empty", PERSONAL), ("wc_orders_meta", "empty", PERSONAL),
    ("wc_order_*", "empty", PERSONAL), ("wc_customer_lookup", "empty", PERSONAL), ("wc_webhooks", "empty", ""), ("woocommerce_order_items", "empty", PERSONAL),
    ("woocommerce_order_itemmeta", "empty", PERSONAL), ("woocommerce_downloadable_product_permissions", "empty", PERSONAL), ("woocommerce_payment_tokens", "empty", PERSONAL),
    ("woocommerce_payment_tokenmeta", "empty", PERSONAL), ("woocommerce_api_keys", "empty", "secrets"), ("gf_entry", "empty", PERSONAL), ("gf_entry_meta", "empty", PERSONAL),
    ("gf_entry_notes", "empty", PERSONAL), ("gf_draft_submissions", "empty", PERSONAL), ("rg_lead*", "empty", PERSONAL), ("rg_incomplete_submissions", "empty", PERSONAL),
    ("rg_form_view", "empty", ADDRESSES), ("rg_form", "keep", ""), ("rg_form_meta", "keep", ""), ("mailpoet_subscriber*", "empty", PERSONAL), ("newsletter", "empty", PERSONAL),
    ("newsletter_*", "empty", PERSONAL), ("gf_form", "keep", ""), ("gf_form_meta", "keep", ""), ("gf_form_revisions", "keep", ""), ("redirection_items", "keep", ""),
    ("redirection_groups", "keep", ""), ("woocommerce_attribute_taxonomies", "keep", ""), ("woocommerce_tax_rates", "keep", ""), ("woocommerce_tax_rate_locations", "keep", ""),
    ("woocommerce_shipping_*", "keep", ""), ("icl_translations", "keep", "kept whole"), ("icl_*", "keep", ""),
)


@dataclass(frozen=True)
class Table:
    """What a rule is found by. site 0: of the network or of none."""

    name: str
    role: str = ""
    site: int = 0
    row_bytes: int = 0
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    action: str
    source: str
    filter_by: str = ""
    note: str = ""


def fits(glob: str, name: str) -> bool:
    """Whether a glob with * ? and [..] fits; none of these crosses a slash."""
    return name.count("/") == glob.count("/") and fnmatchcase(name, glob)


def resolve(table: Table, config: Config, prefixes: dict[int, str], excluded: frozenset[int] = frozenset()) -> Rule:
    """The rule of a table, by site, role, configuration, library, columns and size, in this order."""
    if table.site and table.site in excluded:
        return Rule("drop", "sites", note=f"site {table.site} is excluded")
    of_network = {
        "users": Rule("core", "core"), "usermeta": Rule("core", "core"), "site": Rule("keep", "multisite"), "sitemeta": Rule("keep", "multisite"),
        "signups": Rule("empty", "multisite", note=PERSONAL), "registration_log": Rule("empty", "multisite", note=PERSONAL),
    }
    for role in ("blogs", "blogmeta", "blog_versions"):
        of_network[role] = Rule("filter", "multisite", "blog_id") if excluded else Rule("keep", "multisite")
    if table.role and table.site:
        return Rule("empty", "core", note="comments are always removed") if table.role in ("comments", "commentmeta") else Rule("core", "core")
    if table.role in of_network:
        return of_network[table.role]
    names = [table.name] if table.name in config.tables else [g for g in sorted(config.tables) if set(g) & set("*?[") and fits(g, table.name)]
    if names:
        action, column = config.tables[names[0]]
        if action == "filter" and table.columns and column not in table.columns:
            raise ConfigError(f"tables.{table.name}: no column {column}")
        if action == "filter" and not table.site:
            raise ConfigError(f"tables.{table.name}: filter_by needs a table of a site")
        return Rule(action, "config", column or "")
    prefix = prefixes.get(table.site) or prefixes.get(0) or min(prefixes.values(), key=len, default="")
    if prefix and table.name.startswith(prefix):
        for glob, action, note in LIBRARY:
            if fits(glob, table.name.removeprefix(prefix)):
                return Rule(action, "library", note=note)
    if table.site:
        for column in ("post_id", "object_id"):
            if column in table.columns:
                return Rule("filter", "default", column)
    return Rule("keep", "default", note="unknown and small") if table.row_bytes < SMALL else Rule("empty", "default", note="unknown and large")


CORE = ("term_relationships", "term_taxonomy", "commentmeta", "postmeta", "termmeta", "comments", "options", "links", "terms", "posts")
NETWORK = ("registration_log", "blog_versions", "usermeta", "sitemeta", "blogmeta", "signups", "blogs", "users", "site")


def _prefixes(names: dict[str, int]) -> list[str]:
    return sorted(n.removesuffix("posts") for n in names if n.endswith("posts") and n.removesuffix("posts") + "options" in names)


def main_prefixes(names: dict[str, int]) -> list[str]:
    """Prefixes that may be the main one."""
    found = _prefixes(names)
    return [p for p in found if not any(re.fullmatch(re.escape(q) + r"([2-9]|[1-9]\d+)_", p) for q in found)]


def sites_of(names: dict[str, int]) -> dict[int, str]:
    """Site prefixes by number, from table names and their row counts.

    A prefix has posts and options. The main one is no other's with a number behind; of several that with most posts,
    then the first by name. Its numbered prefixes are the other sites.
    """
    found, mains = _prefixes(names), main_prefixes(names)
    if not mains:
        raise ValueError("no site: no prefix has both posts and options")
    main = max(mains, key=lambda p: (names[p + "posts"], [-ord(c) for c in p]))
    out = {1: main}
    for p in found:
        if m := re.fullmatch(re.escape(main) + r"([2-9]|[1-9]\d+)_", p):
            out[int(m[1])] = p
    return out


def place(name: str, sites: dict[int, str]) -> tuple[int, str]:
    """The site (0: network or none) and the role ("" if it is no core table) of a table."""
    main = sites[1]
    if name.startswith(main) and name.removeprefix(main) in NETWORK:
        return 0, name.removeprefix(main)
    for site, prefix in sorted(sites.items(), key=lambda s: -len(s[1])):
        if name.startswith(prefix):
            rest = name.removeprefix(prefix)
            return site, rest if rest in CORE else ""
    return 0, ""


def suggest(types: list[dict], posts_per_page: int = 10) -> dict[str, dict]:
    """A configuration per type from its profile (type, published, taxonomies by name with their menu terms): small types whole, large ones by category, others by date."""
    out = {}
    for t in types:
        if t["published"] <= 50:
            out[t["type"]] = {"mode": "all"}
        elif t["type"] == "post" and "category" in t["taxonomies"] and t["published"] > 200:
            menus = t["taxonomies"]["category"]
            out["post"] = {"mode": "per_term", "per_term": max(posts_per_page, 10) + 1, "taxonomies": {"category": {"max_terms": 10, "include_menu_terms": menus <= 20}}}
        else:
            out[t["type"]] = {"mode": "latest", "count": 20}
    return out
