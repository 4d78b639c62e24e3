"""Compliance rules over recorded device properties.

Each rule is a list of findings (severity, message), null where it doesn't apply;
check results are dispatched by name, unknown names warn.  The rule on device names
that give automation away is not offered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X

# What the rules compare with.
US_TIMEZONES = [
    "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Phoenix", "America/Anchorage", "America/Adak", "America/Honolulu", "America/Boise",
    "America/Indiana/Indianapolis", "America/Indiana/Knox", "America/Indiana/Marengo", "America/Indiana/Petersburg", "America/Indiana/Tell_City", "America/Indiana/Vevay",
    "America/Indiana/Vincennes", "America/Indiana/Winamac", "America/Juneau", "America/Kentucky/Louisville", "America/Kentucky/Monticello", "America/Menominee",
    "America/Metlakatla", "America/Nome", "America/North_Dakota/Beulah", "America/North_Dakota/Center", "America/North_Dakota/New_Salem", "America/Sitka", "America/Yakutat",
    "Pacific/Honolulu", "US/Eastern", "US/Central", "US/Mountain", "US/Pacific", "US/Alaska", "US/Hawaii", "US/Arizona",
]
MCC = (310, 316)
INSECURE_LOCKS = ["0", "65536", "null"]
ACCOUNT_FILES = ["account", "login", "auth", "session", "token", "user"]
LIMITS = {"package": "com.example.app", "least": "20.0.0", "most": "99.99.99"}

SCHEMA = "device_id string, check string, raw map<string,string>, lists map<string,array<string>>"
FAIL, WARN = "failure", "warning"


def _p(key: str) -> Column:
    return F.coalesce(F.trim(F.col("raw")[key]), F.lit(""))


def _l(key: str) -> Column:
    return F.coalesce(F.col("lists")[key], F.array().cast("array<string>"))


def _when(condition: Column, severity: str, *message: Column | str) -> Column:
    text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), text.alias("message")))


def _listed(items: Column, most: int) -> Column:
    return F.array_join(F.slice(items, 1, most), ", ")


def locale() -> list[Column]:
    own, ro = _p("getprop persist.sys.locale"), _p("getprop ro.product.locale")
    lang, country = _p("getprop persist.sys.language"), _p("getprop persist.sys.country")
    old = F.when((lang != "") & (country != ""), F.concat(lang, F.lit("-"), country)).otherwise("")
    effective = F.when(own != "", own).when(old != "", old).otherwise(ro)
    known = F.filter(F.array(own, old, ro), lambda v: v != "")
    split = F.size(F.array_distinct(F.transform(known, X.locale_key))) > 1
    return [
        _when(effective == "", FAIL, "locale: no property gives a locale"),
        _when((effective != "") & (X.locale_key(effective) != "en-us"), FAIL, "locale: effective locale is '", effective, "', expected 'en-US'"),
        _when(split, WARN, "locale: properties disagree (", F.array_join(known, ", "), ")"),
    ]


def timezone() -> list[Column]:
    tz, auto = _p("getprop persist.sys.timezone"), _p("settings get global auto_time_zone")
    return [
        _when(tz == "", FAIL, "timezone: not set"), _when((tz != "") & ~tz.isin(*US_TIMEZONES), FAIL, "timezone: '", tz, "' is not a US timezone"),
        _when(auto != "0", FAIL, "timezone: automatic timezone is '", auto, "', must be '0'"),
    ]


def gps_location() -> list[Column]:
    mode, grants = _p("location_mode"), _l("location_grants")
    return [_when(mode != "0", FAIL, "gps_location: mode is '", mode, "', must be '0'"), _when(F.size(grants) > 0, FAIL, "gps_location: ", F.size(grants).cast("string"), " app(s) may read the location: ", _listed(grants, 5))]


def wifi() -> list[Column]:
    on, saved = _p("wifi_on"), _l("saved_networks")
    return [_when(on != "0", FAIL, "wifi: wifi_on is '", on, "', must be '0'"), _when(F.size(saved) > 0, FAIL, "wifi: ", F.size(saved).cast("string"), " saved network(s): ", _listed(saved, 3))]


def ip_validation() -> list[Column]:
    ip = _p("public_ip")
    return [_when(ip == "", FAIL, "ip_validation: no public address"), _when((ip != "") & ~X.is_public_ipv4(ip), FAIL, "ip_validation: '", ip, "' is not a public IPv4 address"), _when(X.is_public_ipv4(ip), WARN, "ip_validation: ", ip, " needs a location lookup")]


def sim_mcc() -> list[Column]:
    state, operator = F.upper(_p("getprop gsm.sim.state")), _p("getprop gsm.sim.operator.numeric")
    ready, mcc = state == "READY", F.substring(operator, 1, 3).try_cast("int")
    return [
        _when(state == "ABSENT", WARN, "sim_mcc: no SIM, its country code is stale and ignored"), _when(~state.isin("ABSENT", "READY"), WARN, "sim_mcc: SIM state is '", state, "'"),
        _when(ready & (F.length(operator) < 3), FAIL, "sim_mcc: operator is '", operator, "'"), _when(ready & (F.length(operator) >= 3) & mcc.isNull(), FAIL, "sim_mcc: operator '", operator, "' has no country code"),
        _when(ready & (F.length(operator) >= 3) & ~mcc.between(*MCC), FAIL, "sim_mcc: country code of '", operator, "' is not US"),
    ]


def screen_lock() -> list[Column]:
    off, kind = F.lower(_p("locksettings get-disabled")), _p("settings get secure lockscreen.password_type")
    unsure = ~off.isin("true", "false")
    return [_when(off == "true", FAIL, "screen_lock: disabled"), _when(unsure & kind.isin(*INSECURE_LOCKS), FAIL, "screen_lock: password type '", kind, "' is not secure"), _when(unsure & (kind == ""), WARN, "screen_lock: state unknown")]


def usb_debugging() -> list[Column]:
    return [_when(_p("settings get global adb_enabled") == "1", WARN, "usb_debugging: on"), _when(_p("settings get global development_settings_enabled") == "1", WARN, "usb_debugging: developer options are on")]


def app_state(package: str, least: str, most: str) -> list[Column]:
    there = _p("pm_list").contains(package)
    version = F.nullif(F.regexp_extract(_p("version_name"), r"versionName=(\S+)", 1), F.lit(""))
    number, prefs = X.version_key(version), _p("shared_prefs")
    readable = (prefs != "") & ~prefs.contains("No such file") & ~prefs.contains("Permission denied")
    left = F.filter(F.split(prefs, "\n"), lambda f: f.rlike("(?i)" + "|".join(ACCOUNT_FILES)))
    files = F.transform(F.when(there & readable, left), lambda f: F.struct(F.lit(FAIL).alias("severity"), F.concat(F.lit("app_state: leftover account data '"), F.trim(f), F.lit("'")).alias("message")))
    return [
        _when(~there, FAIL, "app_state: ", F.lit(package), " is not installed"), _when(there & version.isNull(), WARN, "app_state: version unknown"),
        _when(there & (number < X.version_key(F.lit(least))), FAIL, "app_state: version ", version, " is below ", F.lit(least)), _when(there & (number > X.version_key(F.lit(most))), WARN, "app_state: version ", version, " exceeds ", F.lit(most)),
        files,
    ]


def _judged(results: DataFrame, package: str, least: str, most: str) -> DataFrame:
    """The results with found, the list of their findings (severity, message), and known, whether the check is."""
    registry = {"locale": locale(), "timezone": timezone(), "gps_location": gps_location(), "wifi": wifi(), "ip_validation": ip_validation(), "sim_mcc": sim_mcc(), "screen_lock": screen_lock(), "usb_debugging": usb_debugging(), "app_state": app_state(package, least, most)}
    none = F.array().cast("array<struct<severity:string,message:string>>")
    of = F.array(_when(F.lit(True), WARN, "unknown check '", F.coalesce("check", F.lit("")), "'"))
    chosen = None
    for name, rules in registry.items():
        single = F.array(*(rules[:-1] if name == "app_state" else rules))
        every = F.concat(single, F.coalesce(rules[-1], none)) if name == "app_state" else single
        chosen = F.when(F.col("check") == name, every) if chosen is None else chosen.when(F.col("check") == name, every)
    return results.select("device_id", "check", F.filter(chosen.otherwise(of), lambda f: f.isNotNull()).alias("found"), F.coalesce(F.col("check").isin(*registry), F.lit(False)).alias("known"))


def findings(results: DataFrame, **limits: str) -> DataFrame:
    """device_id, check, severity, message for check results of SCHEMA; limits override LIMITS."""
    return _judged(results, **LIMITS | limits).select("device_id", "check", F.inline("found"))


def _count(severity: str) -> Column:
    return F.size(F.filter("found", lambda f: f["severity"] == severity)).cast("long")


def verdicts(results: DataFrame, **limits: str) -> DataFrame:
    """device_id, check, failures, warnings, status (fail, warn, pass), and passed, whether the device has no failure at all.

    Findings are counted in each row; the one shuffle is by device and serves both steps.
    """
    rows = _judged(results, **LIMITS | limits).select("device_id", "check", _count(FAIL).alias("failures"), _count(WARN).alias("warnings"))
    rows = rows.repartition("device_id").groupBy("device_id", "check").agg(F.sum("failures").alias("failures"), F.sum("warnings").alias("warnings"))
    rows = rows.withColumn("status", F.when(F.col("failures") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass"))
    return rows.withColumn("passed", F.sum("failures").over(W.partitionBy("device_id")) == 0)


def reports(results: DataFrame, **limits: str) -> DataFrame:
    """device_id, passed, report: one JSON report a device, as long as its checks are many.

    pass; failures and warnings (messages, sorted by check and message); details, by check
    its failures, warnings and status.  An unknown check only adds a warning.
    """
    texts = lambda severity: F.transform(F.filter("found", lambda f: f["severity"] == severity), lambda f: f["message"])
    rows = _judged(results, **LIMITS | limits).select("device_id", "check", "known", texts(FAIL).alias("failures"), texts(WARN).alias("warnings"))
    status = F.when(F.size("failures") > 0, "fail").when(F.size("warnings") > 0, "warn").otherwise("pass")
    own = F.struct("check", "known", "failures", "warnings", status.alias("status"))
    each = rows.groupBy("device_id").agg(F.sort_array(F.collect_list(own)).alias("checks"))
    every = lambda c: F.flatten(F.transform("checks", lambda x: x[c]))
    known = F.filter("checks", lambda x: x["known"])
    # of a check that came twice the last in order counts in the details
    detail = F.map_from_entries(F.transform(F.array_distinct(F.transform(known, lambda x: x["check"])), lambda c: F.struct(c, F.element_at(F.filter(known, lambda x: x["check"] == c), -1).dropFields("check", "known"))))
    passed = F.size(every("failures")) == 0
    body = F.to_json(F.struct(passed.alias("pass"), every("failures").alias("failures"), every("warnings").alias("warnings"), detail.alias("details")))
    return each.select("device_id", passed.alias("passed"), body.alias("report"))


def exit_code(reported: DataFrame) -> int:
    """0 if every device passes, else 1."""
    return 0 if reported.where("not passed").isEmpty() else 1
