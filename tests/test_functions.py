from pyspark.sql import functions as F

from tidemark.functions import text as X


def one(spark, value, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return df.select(value.alias("v")).first()["v"]


def test_urls(spark):
    cases = {
        "https://www.tiktok.com/@a.b/video/12": ("canonical", "12", "https://www.tiktok.com/@a.b/video/12"),
        "  TikTok.com/@u/video/7?x=1 ": ("canonical", "7", "https://www.tiktok.com/@u/video/7"),
        "ftp://tiktok.com/@user/video/123": ("canonical", "123", "https://www.tiktok.com/@user/video/123"),
        "https://vm.tiktok.com/ZM1/": ("share", None, None), "vt.tiktok.com/abc": ("share", None, None),
        "https://example.com/vm.tiktok.com/x": ("unknown", None, None), "": ("unknown", None, None), "not a url": ("unknown", None, None),
        "https://www.tiktok.com/@a-b/video/12": ("unknown", None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    u = F.col("u")
    got = {r["u"]: tuple(r)[1:] for r in df.select("u", X.url_kind(u), X.video_id(u), X.canonical_url(u)).collect()}
    assert got == cases


def test_captions(spark):
    cases = [("same", "same", True), ("a b c", "a b...", True), ("a b...", "a b c  ", True), ("a b c", "a b d", False), ("a...", "a...", True), ("a...", "b...", False), ("", "", True), ("", "x", False), ("x...", "y", False), ("...", "anything", True), ("long text…", "long text", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    for r in df.select("a", "b", "want", X.captions_match(F.col("a"), F.col("b")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_metric_is_the_highest(spark):
    df = spark.createDataFrame([(45000, 44800, 46000), (1800, 1850, 1780), (None, None, None)], "a long, b long, s long")
    assert [r[0] for r in df.select(X.resolved_metric(F.col("a"), F.col("b"), F.col("s"))).collect()] == [46000, 1850, 0]


def test_times(spark):
    t = lambda s: X.parsed_time(F.lit(s))
    row = spark.range(1).select(t("2025-03-14T10:30:00-05:00") == t("2025-03-14T15:30:00Z"), X.times_close(t("2025-03-14T10:00:00"), t("2025-03-14T11:00:00")), X.times_close(t("2025-03-14T10:00:00"), t("2025-03-14T11:00:01")), t("never")).first()
    assert tuple(row) == (True, True, False, None)


def test_versions_and_text(spark):
    v = lambda s: X.version_numbers(F.lit(s))
    row = spark.range(1).select(v("1.2b.x"), v("34.1") < v("34.1.0"), v("9.0") < v("10"), X.lines_with(F.lit("a allow\nb deny\nc allow"), "allow"), X.screen_size(F.lit("Override size: 1x2\nPhysical size: 1080x2400")), X.screen_size(F.lit("wm 7x8")), X.bounds_centre(F.lit("[0,0][100,200]"), F.lit(200), F.lit(400)), X.pixel(F.lit(0.999), F.lit(100)), X.bounds_centre(F.lit("[0,0]"), F.lit(1), F.lit(1))).first()
    assert row[0] == [1, 2, 0] and row[1] and row[2] and row[3] == ["a allow", "c allow"]
    assert tuple(row[4]) == (1080, 2400) and tuple(row[5]) == (7, 8) and tuple(row[6]) == (0.25, 0.25) and row[7] == 99 and row[8] is None


def test_public_addresses(spark):
    import ipaddress

    cases = "8.8.8.8 10.0.0.1 127.0.0.1 172.16.0.1 172.32.0.1 192.168.1.1 224.0.0.1 255.255.255.255 1.2.3 1.2.3.4.5 300.1.1.1 ::1 abc 100.64.0.1 198.18.0.1 203.0.113.5".split()

    def public(s):
        try:
            a = ipaddress.IPv4Address(s)
        except ValueError:
            return False
        return a.is_global and not (a.is_loopback or a.is_reserved or a.is_multicast)

    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", X.is_public_ipv4(F.col("s"))).collect()} == {c: public(c) for c in cases}


def test_numbers_of_any_length(spark):
    cases = [("20240101123456.1", "20240101123455.9", False), ("9" * 14, "1" + "0" * 14, True), ("00012.3", "12.3", False), ("1.99999999999999999999", "1.100000000000000000000", True), ("", "0.0", True), ("x.1", "0.2", True), ("34.1", "34.1.0", True)]
    df = spark.createDataFrame(cases, "a string, b string, less boolean")
    for r in df.select("a", "b", "less", (X.version_key(F.col("a")) < X.version_key(F.col("b"))).alias("got")).collect():
        assert r["got"] == r["less"], r
    sizes = [("99999999999x1", (None, 1)), ("Physical size: 1080x99999999999999999999", (1080, None)), ("none", (None, None))]
    got = spark.createDataFrame(sizes, "t string, want struct<w:int,h:int>").select(X.screen_size(F.col("t")).alias("s")).collect()
    assert [tuple(r["s"]) for r in got] == [w for _, w in sizes]
    assert one(spark, X.version_numbers(F.col("v")), v="20240101123456.x.7." + "9" * 30) == [20240101123456, 0, 7, None]


def test_long_versions_through_the_rule(spark):
    from tidemark.operators import rules

    raw = lambda v: {"pm_list": "package:com.example.app", "version_name": f"versionName={v}", "shared_prefs": ""}
    found = spark.createDataFrame([(v, "app_state", raw(v), {}) for v in ("20240101123456.1", "34.1", "19.99999999999999", "00000000000000020.0.0")], rules.SCHEMA)
    got = {(r["device_id"], r["severity"]) for r in rules.findings(found).collect()}
    assert got == {("20240101123456.1", "warning"), ("19.99999999999999", "failure")}
