"""Live-feed payloads (JSON, XML) as typed rows.

Payload columns are text. A field that may hold one object or a list of them
is read as its JSON text first, then as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import weather as W
from ..functions.timecode import LOCAL_TZ
from ..operators.schedule import line_name

# Alert limits, delay spellings, forecast lengths.
MAJOR, MINOR = 70, 40
DELAY_WORDS = ["true", "1", "yes"]
PERIODS_READ, PERIODS_KEPT, HEADLINES_KEPT = 13, 6, 3
DEFAULT_TEMPERATURE, DEFAULT_HUMIDITY = 55.0, 50.0


def one_or_many(raw: Column, fields: str) -> Column:
    """JSON text of an object or a list of objects as an array of structs."""
    one = F.from_json(raw, f"struct<{fields}>")
    return (
        F.when(F.ltrim(raw).startswith("["), F.from_json(raw, f"array<struct<{fields}>>"))
        .when(F.ltrim(raw).startswith("{"), F.array(one))
        .otherwise(F.from_json(F.lit("[]"), f"array<struct<{fields}>>"))
    )


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def feed_time(text: Column) -> Column:
    """Local wall-clock time of `yyyyMMdd HH:mm:ss` or ISO, with or without offset."""
    iso = text.contains("T")
    offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    instant = F.convert_timezone(
        F.current_timezone(), F.lit(LOCAL_TZ), text.try_cast("timestamp").cast("timestamp_ntz"))
    compact = F.regexp_replace(
        text, r"^(\d{4})(\d{2})(\d{2}) (\d{2}:\d{2}:\d{2})$", "$1-$2-$3 $4")
    return F.when(iso & offset, instant).otherwise(compact.try_cast("timestamp_ntz"))


def _seconds_between(a: Column, b: Column) -> Column:
    day = F.datediff(a.cast("date"), b.cast("date")) * 86400
    clock = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.extract(F.lit("SECOND"), t)
    return (day + clock(a) - clock(b)).cast("double")


ETA = ("staNm: string, stpDe: string, destNm: string, rt: string, arrT: string, "
       "isApp: string, isDly: string, isSch: string")
TRAIN = "struct<ctatt: struct<errCd: string, errNm: string, eta: string>>"


def parse_train_arrivals(raw: DataFrame, body: str = "body") -> DataFrame:
    """Arrivals of payloads with `station_id, station_label` and local `now`; bad rows drop."""
    doc = F.from_json(F.col(body), TRAIN)["ctatt"]
    # no filter here: one would make the payload parse a second time
    e = raw.select("station_id", "station_label", "now", doc.alias("_doc"))
    eta = F.when(F.coalesce(F.col("_doc.errCd"), F.lit("0")) == "0", F.col("_doc.eta"))
    e = e.select("station_id", "station_label", "now", eta.alias("_eta"))
    e = e.select("station_id", "station_label", "now", F.inline(one_or_many(F.col("_eta"), ETA)))
    e = e.withColumn("_at", feed_time(F.col("arrT")))
    wait = F.greatest(F.lit(0.0), F.bround(_seconds_between(F.col("_at"), F.col("now")) / 60))
    return e.where(F.col("_at").isNotNull()).select(
        F.lit("train").alias("mode"), line_name(_text("rt")).alias("line"), _text("rt").alias("line_code"),
        F.coalesce("staNm", "station_label").alias("station"), F.col("station_id").alias("stop_id"),
        _text("stpDe").alias("platform"), _text("destNm").alias("destination"),
        wait.cast("int").alias("minutes"), (_text("isApp") == "1").alias("is_approaching"),
        (_text("isDly") == "1").alias("is_delayed"), (_text("isSch") == "1").alias("is_scheduled"))


def train_errors(raw: DataFrame, body: str = "body") -> DataFrame:
    """Payloads that carry an error code, or cannot be read at all."""
    doc = F.from_json(F.col(body), TRAIN)["ctatt"]
    code = F.coalesce(doc["errCd"], F.lit("0"))
    broken = F.from_json(F.col(body), TRAIN).isNull() | F.get_json_object(body, "$").isNull()
    return raw.where((code != "0") | broken).select(
        "station_id", F.when(broken, "unreadable").otherwise(code).alias("code"),
        F.coalesce(doc["errNm"], F.lit("")).alias("message"))


PRD = ("rt: string, rtdir: string, stpid: string, stpnm: string, des: string, "
       "prdctdn: string, dly: string, psgld: string")
BUS = "struct<`bustime-response`: struct<prd: string>>"


def parse_bus_predictions(raw: DataFrame, body: str = "body") -> DataFrame:
    """Bus predictions; a countdown that is no number counts as due."""
    doc = F.from_json(F.col(body), BUS)["bustime-response"]["prd"]
    p = raw.select(*[c for c in raw.columns if c != body], F.inline(one_or_many(doc, PRD)))
    left = F.trim(_text("prdctdn"))
    return p.select(
        *[c for c in raw.columns if c != body],
        F.lit("bus").alias("mode"), _text("rt").alias("line_code"),
        F.lower(_text("rtdir")).alias("direction"), _text("stpid").alias("stop_id"),
        _text("stpnm").alias("station"), _text("des").alias("destination"),
        F.when(left.rlike(r"^\d+$"), left.try_cast("int")).otherwise(0).alias("minutes"),
        F.lower(_text("dly")).isin(DELAY_WORDS).alias("is_delayed"),
        F.upper(F.regexp_replace(_text("psgld"), " ", "_")).alias("load"))


ALERT = ("AlertId: string, Headline: string, Impact: string, SeverityScore: string, "
         "EventEnd: string, ImpactedService: struct<Service: string>")


def parse_alerts_json(raw: DataFrame, body: str = "body") -> DataFrame:
    """Alerts with whole-number severity and the ids of the affected routes."""
    doc = F.from_json(F.col(body), "struct<CTAAlerts: struct<Alert: string>>")["CTAAlerts"]["Alert"]
    rest = [c for c in raw.columns if c != body]
    a = raw.select(*rest, F.inline(one_or_many(doc, ALERT)))
    score = F.coalesce(F.nullif("SeverityScore", F.lit("")), F.lit("0")).try_cast("int")
    ids = F.transform(one_or_many(F.col("ImpactedService.Service"), "ServiceId: string"),
                      lambda s: s["ServiceId"])
    return a.where(score.isNotNull()).select(
        *rest, _text("AlertId").alias("alert_id"), _text("Headline").alias("headline"),
        _text("Impact").alias("impact"), score.alias("severity"), (score >= MAJOR).alias("is_major"),
        F.nullif("EventEnd", F.lit("")).alias("event_end"),
        F.filter(ids, lambda x: F.coalesce(x, F.lit("")) != "").alias("affected_routes"))


def severity_class(score: Column) -> Column:
    return F.when(score >= MAJOR, "Major").when(score >= MINOR, "Minor").otherwise("Planned")


ALERT_XML = (
    "struct<Alert: array<struct<AlertId: string, Headline: string, ShortDescription: string, "
    "SeverityScore: string, ImpactedService: struct<Service: array<struct<ServiceName: string>>>>>>"
)


def parse_alerts_xml(raw: DataFrame, body: str = "body") -> DataFrame:
    """Alerts of XML payloads with route names less their " Line" suffix."""
    rest = [c for c in raw.columns if c != body]
    a = raw.select(*rest, F.inline(F.from_xml(F.col(body), ALERT_XML)["Alert"]))
    score = F.coalesce(F.nullif(F.trim("SeverityScore"), F.lit("")), F.lit("0")).try_cast("int")
    names = F.transform(
        F.col("ImpactedService.Service"),
        lambda s: F.regexp_replace(F.trim(F.coalesce(s["ServiceName"], F.lit(""))), " Line$", ""))
    none = F.array().cast("array<string>")
    return a.where(score.isNotNull()).select(
        *rest, _text("AlertId").alias("alert_id"), _text("Headline").alias("headline"),
        _text("ShortDescription").alias("short_description"), score.alias("severity"),
        severity_class(score).alias("severity_class"),
        F.coalesce(F.filter(names, lambda x: x != ""), none).alias("routes"))


def parse_route_status(raw: DataFrame, body: str = "body") -> DataFrame:
    doc = F.from_json(F.col(body), "struct<CTARoutes: struct<RouteInfo: string>>")
    fields = "ServiceId: string, Route: string, RouteStatus: string, RouteStatusColor: string"
    rest = [c for c in raw.columns if c != body]
    r = raw.select(*rest, F.inline(one_or_many(doc["CTARoutes"]["RouteInfo"], fields)))
    return r.select(*rest, _text("ServiceId").alias("service_id"), _text("Route").alias("route"),
                    _text("RouteStatus").alias("status"), _text("RouteStatusColor").alias("status_color"))


def parse_vehicle_positions(raw: DataFrame, body: str = "body") -> DataFrame:
    """Lines with at least one reporting train; payloads with an error code give none."""
    doc = F.from_json(F.col(body), "struct<ctatt: struct<errCd: string, route: string>>")["ctatt"]
    rest = [c for c in raw.columns if c != body]
    r = raw.withColumn("_doc", doc).where(F.coalesce(F.col("_doc.errCd"), F.lit("0")) == "0").select(
        *rest, F.inline(one_or_many(F.col("_doc.route"), "`@name`: string, train: string")))
    n = F.size(one_or_many(F.col("train"), "rn: string"))
    return r.where(n > 0).select(*rest, F.col("@name").alias("line_code"),
                                 line_name(F.col("@name")).alias("line"), n.alias("active_trains"))


def parse_bus_routes(raw: DataFrame, body: str = "body") -> DataFrame:
    doc = F.from_json(F.col(body), "struct<`bustime-response`: struct<error: string, routes: string>>")
    rest = [c for c in raw.columns if c != body]
    r = raw.withColumn("_doc", doc["bustime-response"]).where(F.col("_doc.error").isNull())
    fields = "rt: string, rtnm: string, rtclr: string"
    return r.select(*rest, F.inline(one_or_many(F.col("_doc.routes"), fields))).select(
        *rest, _text("rt").alias("route"), _text("rtnm").alias("name"), _text("rtclr").alias("color"))


PERIOD = ("startTime: string, temperature: double, temperatureUnit: string, shortForecast: string, "
          "windSpeed: string, windGust: string, relativeHumidity: struct<value: double>")


def parse_forecast(raw: DataFrame, body: str = "body") -> DataFrame:
    """Per payload the period rows 0 (current) to 6: temperature, wind, precipitation, feels-like."""
    doc = F.from_json(F.col(body), f"struct<properties: struct<periods: array<struct<{PERIOD}>>>>")
    rest = [c for c in raw.columns if c != body]
    kept = F.slice(doc["properties"]["periods"], 1, min(PERIODS_READ, PERIODS_KEPT + 1))
    p = raw.select(*rest, F.posexplode(kept).alias("place", "p")).select(*rest, "place", "p.*")
    raw_t = F.coalesce("temperature", F.lit(DEFAULT_TEMPERATURE))
    temp = F.when(F.coalesce("temperatureUnit", F.lit("F")) == "C", raw_t * 9 / 5 + 32).otherwise(raw_t)
    wind = W.wind_mph(_text("windSpeed"))
    gust = F.when(F.trim(_text("windGust")) != "", W.wind_mph(F.col("windGust")))
    value = F.col("relativeHumidity.value")
    humidity = F.when(value != 0, value).otherwise(DEFAULT_HUMIDITY)
    sf = _text("shortForecast")
    hour = F.coalesce(F.substring(F.regexp_extract("startTime", r"T(\d{2}):", 1), 1, 2).try_cast("int"), F.lit(0))
    return p.select(
        *rest, "place", hour.alias("hour"), temp.alias("temperature_f"),
        F.round(W.feels_like_f(temp, wind, F.coalesce(humidity, F.lit(DEFAULT_HUMIDITY))), 1).alias("feels_like_f"),
        sf.alias("short_forecast"), wind.alias("wind_mph"), gust.alias("gust_mph"),
        W.precipitation_type(sf).alias("precipitation"), W.precipitation_intensity(sf).alias("intensity"))


def parse_forecast_alerts(raw: DataFrame, body: str = "body") -> DataFrame:
    """First three distinct headlines (or event names) of alert payloads."""
    doc = F.from_json(
        F.col(body), "struct<features: array<struct<properties: struct<headline: string, event: string>>>>")
    heads = F.transform(doc["features"], lambda f: F.coalesce(
        F.nullif(f["properties"]["headline"], F.lit("")), f["properties"]["event"], F.lit("")))
    distinct = F.array_distinct(F.filter(heads, lambda h: h != ""))
    rest = [c for c in raw.columns if c != body]
    return raw.select(*rest, F.slice(distinct, 1, HEADLINES_KEPT).alias("headlines"))
