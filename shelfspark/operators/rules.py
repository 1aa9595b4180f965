"""What is known of a site: a small description made on the driver, and tables of it to join with."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


@dataclass(frozen=True)
class SiteRule:
    """``*_patterns`` are Java regular expressions, matched anywhere and in either case."""

    id: str
    hostnames: tuple[str, ...]
    label: str = ""
    product_patterns: tuple[str, ...] = ()
    category_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    positive_texts: tuple[str, ...] = ()
    negative_texts: tuple[str, ...] = ()
    keep_out_of_stock: bool = True
    strict_paths: bool = False
    page_limits: tuple[int, int] = (30, 150)

    @property
    def hosts(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(h.strip().lower().removeprefix("www.") for h in self.hostnames))

    @property
    def name(self) -> str:
        return self.label or " ".join(p[:1].upper() + p[1:] for p in self.id.replace("_", "-").split("-") if p)

    def limits(self, max_pages: int | None = None, max_products: int | None = None) -> tuple[int, int]:
        """What a run of the site is limited to: what is asked for, else the site's own ``page_limits``."""
        return self.page_limits[0] if max_pages is None else max_pages, self.page_limits[1] if max_products is None else max_products

    def aliases(self) -> set[str]:
        return {"".join(c for c in x.lower() if c.isalnum()) for x in (self.id, self.name, *self.hosts)}


@dataclass(frozen=True)
class RuleBook:
    rules: tuple[SiteRule, ...] = field(default_factory=tuple)

    def hosts_for(self, site: str) -> list[str]:
        """Hosts that a filter's text means: a rule's by its id, label or host, else the text's own host; none for an empty key."""
        text = site.strip().lower()
        host = text.replace("https://", "").replace("http://", "").split("/")[0].removeprefix("www.")
        keys = {"".join(c for c in x if c.isalnum()) for x in (text, host)} - {""}
        for rule in self.rules:
            if keys & rule.aliases():
                return list(rule.hosts)
        return [host] if "." in host else []

    def table(self, spark: SparkSession) -> DataFrame:
        """(rule_id, label, canonical_host, host): one row per host."""
        rows = [(r.id, r.name, r.hosts[0] if r.hosts else r.id, h) for r in self.rules for h in r.hosts]
        return spark.createDataFrame(rows, "rule_id string, label string, canonical_host string, host string")

    def admitted(self, url: Column) -> Column:
        """Whether the address is on a host of any rule."""
        return F.coalesce(urls.hostname(url).isin([h for r in self.rules for h in r.hosts]), F.lit(False))

    def without_sites(self, df: DataFrame, url: str, exclude: str) -> DataFrame:
        """Rows whose site no token of ``exclude`` (split at commas and spaces) names by host, id or label."""
        tokens = {t.lower() for t in exclude.replace(",", " ").split()}
        hosts = {h for r in self.rules if tokens & ({r.id.lower(), r.name.lower()} | set(r.hosts)) for h in r.hosts} | {t.removeprefix("www.") for t in tokens}
        return df.where(~F.coalesce(urls.hostname(F.col(url)).isin(sorted(hosts)), F.lit(False))) if tokens else df


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.coalesce(text.rlike(f"(?i){p}"), F.lit(False))
    return found
