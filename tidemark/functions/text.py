"""Column functions for URLs, captions, versions, times and device text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts, path shapes and limits that results depend on.
CANONICAL = r"(?iU)(?:https?://)?(?:www\.)?tiktok\.com/@[\w.]+/video/(\d+)"
SHARE = r"(?iU)^(?:https?://)?(?:vm|vt)\.tiktok\.com/\w+/?"
HANDLE = r"(?U)@([\w.]+)"
CANONICAL_HOST = "https://www.tiktok.com"
CLOSE_SECONDS = 3600

_SPACE_LEFT, _SPACE_RIGHT = r"(?U)^\s+", r"(?U)\s+$"


def stripped(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, _SPACE_LEFT, ""), _SPACE_RIGHT, "")


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, CANONICAL, 1), F.lit(""))


def is_share_url(url: Column) -> Column:
    return stripped(url).rlike(SHARE)


def canonical_url(url: Column) -> Column:
    """Null without a video id; an empty handle where the URL has none."""
    v = video_id(url)
    return F.when(v.isNotNull(), F.concat(F.lit(CANONICAL_HOST + "/@"), F.regexp_extract(url, HANDLE, 1), F.lit("/video/"), v))


def url_kind(url: Column) -> Column:
    s = stripped(url)
    return F.when(video_id(s).isNotNull(), "canonical").when(s.rlike(SHARE), "share").otherwise("unknown")


def parsed_time(s: Column) -> Column:
    """ISO text with Z, an offset or none (then UTC); the session's zone must be UTC."""
    return s.try_cast("timestamp")


def is_truncated(caption: Column) -> Column:
    return F.regexp_replace(caption, _SPACE_RIGHT, "").endswith("...")


def captions_match(a: Column, b: Column) -> Column:
    """Equal, or one is the other's beginning where that one is cut with three dots."""
    x, y = F.regexp_replace(a, _SPACE_RIGHT, ""), F.regexp_replace(b, _SPACE_RIGHT, "")
    head = lambda s: F.substr(s, F.lit(1), F.length(s) - 3)
    cut_x, cut_y = x.endswith("..."), y.endswith("...")
    return (
        F.when(x == y, True).when(cut_x & ~cut_y, y.startswith(head(x))).when(cut_y & ~cut_x, x.startswith(head(y))).when(cut_x & cut_y, head(x) == head(y)).otherwise(False)
    )


def times_close(a: Column, b: Column, seconds: int = CLOSE_SECONDS) -> Column:
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.abs(micros(a) - micros(b)) <= seconds * 1_000_000


def resolved_metric(*sources: Column) -> Column:
    """Highest value any source has, else 0."""
    return F.coalesce(F.greatest(*sources), F.lit(0))


def _leading_digits(v: Column) -> Column:
    return F.transform(F.split(v, r"\."), lambda p: F.regexp_extract(p, r"^([0-9]*)", 1))


def version_numbers(v: Column) -> Column:
    """Leading digits of each dotted part as numbers, 0 without, null beyond 18 digits; see ``version_key`` for comparing."""
    return F.transform(_leading_digits(v), lambda d: F.when(d == "", 0).when(F.length(F.ltrim(d, F.lit("0"))) <= 18, d.try_cast("long")).cast("long"))


def version_key(v: Column) -> Column:
    """Dotted versions in the order of their numbers, of any number of digits; arrays compare as tuples do.

    A number without its leading zeros is greater if it is longer, else by its digits.
    """
    bare = F.transform(_leading_digits(v), lambda d: F.ltrim(d, F.lit("0")))
    return F.transform(bare, lambda d: F.struct(F.length(d).alias("length"), d.alias("digits")))


def elapsed_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two times, with their fraction; null while either is lacking."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(finished) - micros(started)) / F.lit(1e6)


def backoff_seconds(attempt: Column, jitter: Column, base: float = 1.0, most: float = 30.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt) + jitter, F.lit(most))


def locale_key(s: Column) -> Column:
    return F.replace(F.lower(s), F.lit("_"), F.lit("-"))


def lines_with(text: Column, *tokens: str) -> Column:
    """Lines that hold every token."""

    def has(line: Column) -> Column:
        hit = F.lit(True)
        for t in tokens:
            hit = hit & line.contains(t)
        return hit

    return F.filter(F.split(text, "\n"), has)


def bounds_centre(bounds: Column, width: Column, height: Column) -> Column:
    """Centre of ``[x1,y1][x2,y2]`` as shares of the screen; null if it isn't of that form."""
    at = [F.regexp_extract(bounds, r"\[(\d+),(\d+)\]\[(\d+),(\d+)\]", i).try_cast("double") for i in range(1, 5)]
    return F.when(at[0].isNotNull(), F.struct(((at[0] + at[2]) / 2 / width).alias("x"), ((at[1] + at[3]) / 2 / height).alias("y")))


def pixel(share: Column, size: Column) -> Column:
    return (share * size).cast("int")


def screen_size(text: Column) -> Column:
    """``WxH`` after "Physical size", else the first ``WxH``; a side that no int holds is null."""
    named, first = r"Physical size:\s*(\d+)x(\d+)", r"(\d+)x(\d+)"
    pick = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, named, i), F.lit("")), F.nullif(F.regexp_extract(text, first, i), F.lit(""))).try_cast("int")
    return F.struct(pick(1).alias("width"), pick(2).alias("height"))


# Networks that are not public, and single addresses inside them that are.
RESERVED = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
PUBLIC_WITHIN = ["192.0.0.9", "192.0.0.10"]


def is_public_ipv4(s: Column) -> Column:
    """A dotted address that the world can reach: in no private, loopback, reserved or multicast network."""
    parts = F.transform(F.split(s, r"\."), lambda p: F.when(p.rlike(r"^(?:0|[1-9][0-9]{0,2})$"), p.cast("long")))
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    public = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p <= 255, F.lit(False)))
    for net in RESERVED:
        base, bits = net.split("/")
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        public = public & ~n.between(low, low + (1 << (32 - int(bits))) - 1)
    return F.coalesce(public | s.isin(*PUBLIC_WITHIN), F.lit(False))
