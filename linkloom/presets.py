"""Settings for sites with known feed addresses, chosen by name or by a feed's URL; users add their own from JSON or Python files."""

from __future__ import annotations

import json
import re
import runpy
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from types import ModuleType

from pyspark.sql import Column

from .functions.templates import Templates, url_variants

SCHEMES = ("http", "https")


@dataclass(frozen=True)
class Preset:
    """site: pattern of the site's URLs; feeds: pattern -> URL templates of its feeds; follow: domains that links are
    followed to; feed_state: selection mode; ignore: domains that are no sites of users."""

    site: str
    feeds: dict[str, Templates]
    follow: tuple[str, ...] = ()
    depth: int = 2
    feed_state: str = "all"
    ignore: tuple[str, ...] = field(default=())


def _both(host: str, endings: list[str]) -> list[str]:
    return [f"{scheme}://{host}/{ending}" for scheme in SCHEMES for ending in endings]


# Addresses of feeds, patterns of the sites and their own domains.
_WORDPRESS = ["?feed=rss", "?feed=rss2", "?feed=rdf", "?feed=atom", "feed/", "feed/rss/", "feed/rss2/", "feed/rdf/", "feed/atom/"]
_TUMBLR = ["rss", "rss#_=_"]
_LIVEJOURNAL = ["data/rss", "data/atom"]
_TUMBLR_OWN = ("www.tumblr.com", "staff.tumblr.com", "tumblr.com", "engineering.tumblr.com", "support.tumblr.com", "assets.tumblr.com")

_HOST = "%(netloc)s"
PRESETS = {
    "wordpress": Preset(r".*\.wordpress\.com/?.*", {r".*\.wordpress\.com/?.*": _both(_HOST, _WORDPRESS)}, ("wordpress.com",)),
    "tumblr": Preset(
        r".*\.tumblr\.com/?.*",
        {r"https?://(.*)-deactivated\d*\.tumblr\.com/?.*": _both("%(1)s.tumblr.com", _TUMBLR) + _both(_HOST, _TUMBLR), r".*\.tumblr\.com/?.*": _both(_HOST, _TUMBLR)},
        ("tumblr.com",), feed_state="dead+", ignore=_TUMBLR_OWN,
    ),
    "livejournal": Preset(r".*\.livejournal\.com/?.*", {r".*\.livejournal\.com/?.*": [f"{s}://{_HOST}/{e}" for e in _LIVEJOURNAL for s in SCHEMES]}, ("livejournal.com",)),
}


def load(path: str) -> Preset:
    """A preset from a file: a JSON object with a preset's fields, or a Python file that has them as upper-case names, in which
    feeds may be functions. A Python file is run, so it is to be the user's own."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    else:
        found = {k.lower(): v for k, v in runpy.run_path(path).items() if k.isupper() and not isinstance(v, ModuleType)}
    known = [f.name for f in fields(Preset)]
    if wrong := sorted(set(found) - set(known)):
        raise KeyError(f"{path} has {', '.join(wrong)}; known are {', '.join(known)}")
    return Preset(**{k: tuple(v) if k in ("follow", "ignore") else v for k, v in found.items()})


def register(folder: str) -> list[str]:
    """Adds the presets of a folder's .json and .py files under the files' names, before the built-in ones; the names."""
    found = {p.stem: load(str(p)) for p in sorted(Path(folder).iterdir()) if p.suffix in (".json", ".py") and not p.stem.startswith("_")}
    built_in = {k: v for k, v in PRESETS.items() if k not in found}
    PRESETS.clear()
    PRESETS.update({**found, **built_in})
    return list(found)


def for_feed(url: str) -> Preset | None:
    """The first preset whose site pattern matches a feed's URL from its start."""
    return next((p for p in PRESETS.values() if re.match(p.site, url)), None)


def chosen(name: str | None, feed_url: str) -> Preset:
    """The preset of a name or file; without one that of the feed's site, or the default: all links, no feeds known."""
    if name is None:
        return for_feed(feed_url) or Preset(".*", {}, depth=1)
    if name in PRESETS:
        return PRESETS[name]
    if name.endswith((".json", ".py")):
        return load(name)
    raise KeyError(f"no preset {name}; known are {', '.join(PRESETS)}")


def feed_candidates(url: Column, first: Mapping[str, Templates] | None = None) -> Column:
    """Possible feed URLs of a page's URL by all presets, after the patterns of ``first``; null where none knows the site."""
    patterns = dict(first or {})
    for p in PRESETS.values():
        patterns.update({k: v for k, v in p.feeds.items() if k not in patterns})
    return url_variants(url, patterns)
