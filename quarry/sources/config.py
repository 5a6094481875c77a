"""The project's configuration: defaults, overrides and checks."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

#: Types that are always kept or never.
ALWAYS_KEPT = (
    "nav_menu_item", "wp_navigation", "wp_template", "wp_template_part", "wp_global_styles", "wp_block", "wp_font_family",
    "wp_font_face", "custom_css", "acf-field-group", "acf-field", "acf-post-type", "acf-taxonomy",
)
ALWAYS_DROPPED = (
    "revision", "customize_changeset", "oembed_cache", "shop_order", "shop_order_refund", "shop_order_placehold",
    "shop_subscription", "user_request", "flamingo_inbound", "flamingo_contact", "scheduled-action",
)
MODES = ("all", "latest", "per_term", "none")
ALL = -1


class ConfigError(ValueError):
    """A key that is unknown, or a value that makes no sense."""


def amount(value: object, where: str) -> int:
    """"all" or a number from 0 on."""
    if value == "all":
        return ALL
    if isinstance(value, int) and not isinstance(value, bool) and value >= 0:
        return value
    raise ConfigError(f"{where}: expected all or a number from 0 on, got {value!r}")


@dataclass
class TaxonomyPick:
    max_terms: int = ALL
    order: str = "count"
    include_menu_terms: bool = True


@dataclass
class PostType:
    mode: str = "latest"
    count: int = 10
    per_term: int = 0
    taxonomies: dict[str, TaxonomyPick] = field(default_factory=dict)
    statuses: dict[str, int] = field(default_factory=lambda: {"publish": ALL})


@dataclass
class Config:
    project: str = ""
    target_size_mb: float = 10
    dependency_depth: int = 2
    default_post_type: PostType = field(default_factory=PostType)
    post_types: dict[str, PostType] = field(default_factory=dict)
    prune_unused_flat_terms_over: int = 500
    include_roles: tuple[str, ...] = ("administrator",)
    meta_exclude_keys: tuple[str, ...] = ()
    options_exclude: tuple[str, ...] = ()
    extra_meta_keys: tuple[str, ...] = ()
    tables: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    local_url: str | None = None
    local_sites: dict[int, str] = field(default_factory=dict)
    allowed_domains: tuple[str, ...] = ()
    allowed_emails: tuple[str, ...] = ()
    sites: dict[str, dict] = field(default_factory=dict)

    def excluded(self, site: int) -> bool:
        own = self.sites.get(str(site), {}).get("exclude")
        return bool(self.sites.get("*", {}).get("exclude") if own is None else own)

    def for_site(self, site: int) -> Config:
        """Top level, then "*", then the site: types override by name, meta keys add up."""
        out = Config(**{f.name: getattr(self, f.name) for f in fields(self)})
        out.post_types = dict(self.post_types)
        for key in ("*", str(site)):
            own = self.sites.get(key, {})
            out.default_post_type = own.get("default_post_type", out.default_post_type)
            out.post_types |= own.get("post_types", {})
            out.extra_meta_keys += own.get("extra_meta_keys", ())
        return out


def _only(found: object, known: set[str], where: str) -> dict:
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ConfigError(f"{where}: expected keys")
    if extra := set(map(str, found)) - known:
        raise ConfigError(f"{where}: unknown {', '.join(sorted(extra))}")
    return found


def _strings(found: object, where: str) -> tuple[str, ...]:
    if not isinstance(found, list | tuple) or not all(isinstance(x, str) for x in found):
        raise ConfigError(f"{where}: expected a list of names")
    return tuple(found)


def _post_type(found: object, where: str) -> PostType:
    own = _only(found, {"mode", "count", "per_term", "taxonomies", "statuses"}, where)
    out = PostType(mode=own.get("mode", "latest"), count=own.get("count", 10), per_term=own.get("per_term", 0))
    if out.mode not in MODES:
        raise ConfigError(f"{where}.mode: {out.mode!r} is none of {', '.join(MODES)}")
    if out.mode == "per_term" and (not own.get("taxonomies") or out.per_term < 1):
        raise ConfigError(f"{where}: per_term needs taxonomies and a number from 1 on")
    if out.mode == "latest" and (not isinstance(out.count, int) or out.count < 1):
        raise ConfigError(f"{where}.count: expected a number from 1 on")
    for name, pick in _only(own.get("taxonomies"), set(own.get("taxonomies") or ()), where).items():
        one = _only(pick, {"max_terms", "order", "include_menu_terms"}, f"{where}.taxonomies.{name}")
        if one.get("order", "count") not in ("count", "name"):
            raise ConfigError(f"{where}.taxonomies.{name}.order: count or name")
        out.taxonomies[name] = TaxonomyPick(amount(one.get("max_terms", "all"), where), one.get("order", "count"), bool(one.get("include_menu_terms", True)))
    if "statuses" in own:
        out.statuses = {k: amount(v, f"{where}.statuses.{k}") for k, v in own["statuses"].items()}
    return out


def load(text: str) -> Config:
    """A configuration from YAML. Unknown keys and senseless values raise ConfigError."""
    import yaml

    top = _only(yaml.safe_load(text), {"project", "target_size_mb", "dependency_depth", "default_post_type", "post_types", "taxonomies", "users", "meta", "options", "references", "tables", "local", "scrub", "sites"}, "config")
    out = Config(project=str(top.get("project") or ""), target_size_mb=top.get("target_size_mb") or 10, dependency_depth=top.get("dependency_depth", 2))
    if out.target_size_mb < 0:
        raise ConfigError("target_size_mb: below 0")
    if not isinstance(out.dependency_depth, int) or out.dependency_depth < 0:
        raise ConfigError("dependency_depth: expected a number from 0 on")
    if "default_post_type" in top:
        out.default_post_type = _post_type(top["default_post_type"], "default_post_type")

    def types(found: object, where: str) -> dict[str, PostType]:
        for name in found or {}:
            if name in ALWAYS_KEPT + ALWAYS_DROPPED:
                raise ConfigError(f"{where}.{name}: this type is fixed")
        return {name: _post_type(own, f"{where}.{name}") for name, own in (found or {}).items()}

    out.post_types = types(top.get("post_types"), "post_types")
    out.prune_unused_flat_terms_over = _only(top.get("taxonomies"), {"prune_unused_flat_terms_over"}, "taxonomies").get("prune_unused_flat_terms_over", 500)
    if out.prune_unused_flat_terms_over < 0:
        raise ConfigError("taxonomies.prune_unused_flat_terms_over: below 0")
    out.include_roles = _strings(_only(top.get("users"), {"include_roles"}, "users").get("include_roles", ["administrator"]), "users.include_roles")
    out.meta_exclude_keys = _strings(_only(top.get("meta"), {"exclude_keys"}, "meta").get("exclude_keys", []), "meta.exclude_keys")
    out.options_exclude = _strings(_only(top.get("options"), {"exclude"}, "options").get("exclude", []), "options.exclude")
    out.extra_meta_keys = _strings(_only(top.get("references"), {"extra_meta_keys"}, "references").get("extra_meta_keys", []), "references")
    for name, rule in (top.get("tables") or {}).items():
        if rule in ("keep", "empty"):
            out.tables[name] = (rule, None)
        elif isinstance(rule, dict) and set(rule) == {"filter_by"} and rule["filter_by"]:
            out.tables[name] = ("filter", str(rule["filter_by"]))
        else:
            raise ConfigError(f"tables.{name}: keep, empty or filter_by")
    local = _only(top.get("local"), {"url", "sites"}, "local")
    out.local_url = local.get("url")
    out.local_sites = {int(k): str(v) for k, v in (local.get("sites") or {}).items()}
    if out.local_sites and not out.local_url:
        raise ConfigError("local.sites needs local.url")
    if any(k < 2 for k in out.local_sites):
        raise ConfigError("local.sites: the main site has local.url")
    scrub = _only(top.get("scrub"), {"profile", "allowed_domains", "allowed_emails"}, "scrub")
    if scrub.get("profile", "default") != "default":
        raise ConfigError("scrub.profile: default is the only one")
    out.allowed_domains, out.allowed_emails = _strings(scrub.get("allowed_domains", []), "scrub"), _strings(scrub.get("allowed_emails", []), "scrub")
    for key, own in (top.get("sites") or {}).items():
        own = _only(own, {"exclude", "default_post_type", "post_types", "references"}, f"sites.{key}")
        if str(key) != "*" and not str(key).isdigit():
            raise ConfigError(f"sites.{key}: a number or *")
        if str(key) == "1" and own.get("exclude"):
            raise ConfigError("sites.1: the main site can't be left out")
        site = {k: v for k, v in own.items() if k == "exclude"}
        if "default_post_type" in own:
            site["default_post_type"] = _post_type(own["default_post_type"], f"sites.{key}.default_post_type")
        site["post_types"] = types(own.get("post_types"), f"sites.{key}.post_types")
        site["extra_meta_keys"] = _strings(_only(own.get("references"), {"extra_meta_keys"}, f"sites.{key}.references").get("extra_meta_keys", []), f"sites.{key}")
        out.sites[str(key)] = site
    return out
