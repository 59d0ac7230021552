"""Anomaly reports from row extracts: one row a line of a sheet, its cells as text in an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.functions.moments import conservative_available_at
from tremora.functions.textual import canonical_decimal, flags, joined_parts, stable_uuid
from tremora.operators.sequences import missing_numbers, serial_faults

#: Sheets in order; all but the last share one layout.
SHEETS = ("形变", "流体", "电磁", "跨断层")
#: The header rows of both layouts.
COMMON = (
    "序号", "报告类型", "报告日期", "单位", "台站", "经度", "纬度", "分量名", "测点编号", "学科", "预报效能", "趋势性异常时间", "异常是否结束", "异常起始时间", "异常结束时间", "异常持续时间",
    "异常类型", "异常特征描述", "年度异常", "R值", "R0值", "震例信息", "中长期_短期", "新增_持续_取消", "预测区域", "预测地点", "预测起始震级", "预测结束震级", "预测起始时间", "预测结束时间", "其它说明",
)
CROSS_FAULT = (
    "序号", "报告类型", "报告日期", "单位", "场地", "经度", "纬度", "分量名", "手段", "观测周期", "预报效能", "趋势性异常时间", "异常是否结束", "异常起始时间", "异常结束时间", "异常持续时间",
    "异常特征描述", "异常幅度_百分比或幅度值", "异常幅度值单位", "年度异常", "R值", "R0值", "中长期_短期", "新增_持续_取消", "现场异常核实次数", "现场核实报告名称", "分析意见", "预测时间_月", "预测强度", "异常信度", "震例信息", "其它说明",
)
#: File names with year, period and date of the report; flags and states that a row may hold.
FILE_NAME = r"(?i)异常零数据All(\d{4})(\d{2})期周报-修改-(\d{8})\.XLS$"
END_FLAGS, STATES = ("是", "否"), ("新增", "持续", "取消")
#: Cells of each layout that hold people's forecasts: never carried on.
FORECAST = {True: ("震例信息", *COMMON[24:]), False: CROSS_FAULT[24:]}


def header_faults(headers: DataFrame) -> DataFrame:
    """file and fault of files whose sheets are not SHEETS in order, or whose header rows differ. headers: file,
    position (from 0), sheet, cells."""
    wanted = F.when(F.col("sheet") == SHEETS[3], F.array(*map(F.lit, CROSS_FAULT))).otherwise(F.array(*map(F.lit, COMMON)))
    sheet = F.element_at(F.array(*map(F.lit, SHEETS)), (F.col("position") + 1).cast("int"))
    known = headers.filter(F.col("position").between(0, 3)).withColumn("good", (sheet == F.col("sheet")) & (F.col("cells") == wanted))
    whole = known.groupBy("file").agg(F.count_if("good").alias("good"))
    return headers.groupBy("file").agg(F.count("*").alias("sheets")).join(whole, "file", "left").filter((F.col("sheets") != 4) | ~F.col("good").eqNullSafe(F.lit(4))).select("file", F.when(F.col("sheets") != 4, "sheets").otherwise("headers").alias("fault"))


def day(text: Column) -> Column:
    """A date as text, with or without a time of midnight behind it."""
    return F.to_date(F.substring(F.regexp_replace(text, "[/.]", "-"), 1, 10).try_cast("date"))


def observations(rows: DataFrame) -> DataFrame:
    """Typed columns, identities and flags of every row; ``fault`` names what makes a row unusable. rows: file, sha256,
    sheet, source_row, cells.

    The two layouts hold the same things in different places; the cross-fault sheet's trend column is a period and no
    date. Forecasts that people made are not read but for whether there are any."""
    plain = F.transform("cells", lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    rows = rows.withColumn("cells", F.transform(plain, lambda x: F.when(x != "", x)))  # once a row: as an expression of each use, the code is too long to be compiled
    cell = lambda i: F.get("cells", F.lit(i))
    common = F.col("sheet") != SHEETS[3]
    either = lambda a, b: F.when(common, cell(COMMON.index(a)) if a else F.lit(None)).otherwise(cell(CROSS_FAULT.index(b)) if b else F.lit(None))
    at = lambda name: cell(COMMON.index(name))  # noqa: E731  the same place in both
    any_of = lambda names, layout: F.exists(F.array(*[cell(layout.index(n)) for n in names]), lambda x: x.isNotNull())
    named = lambda i: F.regexp_extract("file", FILE_NAME, i)
    out = rows.withColumns({
        "report_year": named(1).try_cast("int"), "report_period": named(2).try_cast("int"), "report_date": F.to_date(F.try_to_timestamp(F.nullif(named(3), F.lit("")), F.lit("yyyyMMdd"))),
        "serial": at("序号").try_cast("double").cast("int"), "row_report_date": day(at("报告日期")), "unit": at("单位"), "station_name": either("台站", "场地"),
        "longitude": at("经度").try_cast("decimal(10,5)"), "latitude": at("纬度").try_cast("decimal(10,5)"), "measurement": at("分量名"), "instrument_or_method": either("测点编号", "手段"),
        "discipline": F.when(common, at("学科")).otherwise(F.col("sheet")), "observation_period": either(None, "趋势性异常时间"), "trend_time": day(either("趋势性异常时间", None)),
        "anomaly_type": either("异常类型", None), "anomaly_description": either("异常特征描述", "异常特征描述"), "annual_anomaly": either("年度异常", "年度异常"), "r_value": either("R值", "R值"), "r0_value": either("R0值", "R0值"),
        "term_class": at("中长期_短期"), "forecast_efficacy": at("预报效能"), "end_flag": at("异常是否结束"), "start_date": day(at("异常起始时间")), "reported_end_date": day(at("异常结束时间")), "report_state": at("新增_持续_取消"),
        "has_duration": at("异常持续时间").isNotNull(), "has_forecast": F.when(common, any_of(FORECAST[True], COMMON)).otherwise(any_of(FORECAST[False], CROSS_FAULT)),
    })
    fault = (
        F.when(~F.col("sheet").isin(*SHEETS), "sheet").when(F.col("report_date").isNull(), "file_name").when(F.col("row_report_date").isNull(), "report_date").when(F.col("unit").isNull(), "unit")
        .when(common & ~F.col("discipline").eqNullSafe(F.col("sheet")), "discipline").when(~F.col("end_flag").isin(*END_FLAGS) | F.col("end_flag").isNull(), "end_flag").when(F.col("start_date").isNull(), "start_time")
        .when(~F.col("report_state").isin(*STATES) | F.col("report_state").isNull(), "report_state").when((F.abs("longitude") > 180) | (F.abs("latitude") > 90), "range")
    )
    out = out.withColumn("fault", fault)
    placed = F.col("station_name").isNotNull() & F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    known = F.greatest("report_date", "row_report_date")
    end, state = F.col("reported_end_date"), F.col("report_state")
    before, after = F.col("row_report_date") < F.col("report_date"), F.col("row_report_date") > F.col("report_date")
    marks = flags(
        row_report_date_mismatch_source=before | after, row_report_date_before_source=before, row_report_date_after_source=after, available_at_conservatively_delayed=after,
        missing_station_name=F.col("station_name").isNull(), missing_longitude=F.col("longitude").isNull(), missing_latitude=F.col("latitude").isNull(), missing_measurement=F.col("measurement").isNull(),
        identity_incomplete=~placed | F.col("measurement").isNull(), entity_unresolved=~placed | F.col("measurement").isNull(),
        future_reported_end_time=end > F.col("report_date"), end_after_raw_row_report_date=end > F.col("row_report_date"), end_before_start=end < F.col("start_date"), listed_after_reported_end=end < F.col("report_date"),
        start_after_report_date=F.col("start_date") > known, end_flag_inconsistent=(F.col("end_flag") == END_FLAGS[0]) != end.isNotNull(),
        cancel_without_end_time=(state == STATES[2]) & end.isNull(), continued_with_end_time=(state == STATES[1]) & end.isNotNull(), new_with_end_time=(state == STATES[0]) & end.isNotNull(),
        cross_fault_trend_field_is_period=~common, source_duration_ignored=F.col("has_duration"), manual_prediction_fields_present=F.col("has_forecast"),
        manual_prediction_fields_excluded=F.lit(True), anomaly_time_date_only_assumed_fixed_utc_plus_08_midnight=F.lit(True),
    )
    own = joined_parts(F.lit("anomaly_observation"), F.col("sha256"), F.col("sheet"), F.col("source_row"))
    out = out.withColumns({"quality_flags": marks, "right_censored": end.isNull() | (end > known), "available_at": conservative_available_at(F.col("report_date"), F.col("row_report_date")), "observation_id": stable_uuid(own)})
    place = joined_parts(F.lit("station"), F.col("unit"), F.col("station_name"), canonical_decimal(F.col("longitude"), 5), canonical_decimal(F.col("latitude"), 5))
    out = out.withColumn("station_id", stable_uuid(F.when(placed, place).otherwise(joined_parts(F.lit("station_provisional"), F.col("observation_id")))))
    what = joined_parts(F.lit("anomaly"), F.col("station_id"), F.col("discipline"), F.col("measurement"), F.col("instrument_or_method"), F.col("start_date"))
    resolved = placed & F.col("measurement").isNotNull()
    return out.withColumn("anomaly_id", stable_uuid(F.when(resolved, what).otherwise(joined_parts(F.lit("anomaly_provisional"), F.col("observation_id"))))).drop("cells", "has_duration", "has_forecast")


def observation_table(found: DataFrame, source_id: str) -> DataFrame:
    """Good observations with the columns of their contract."""
    local = lambda c: F.to_timestamp_ntz(F.col(c))
    return found.filter("fault is null").select(
        "observation_id", "anomaly_id", "station_id", "report_date", F.col("row_report_date").alias("raw_row_report_date"), "available_at", "unit", "station_name", F.col("longitude").cast("double").alias("longitude"),
        F.col("latitude").cast("double").alias("latitude"), "discipline", "measurement", "instrument_or_method", "observation_period", "forecast_efficacy", "trend_time", local("start_date").alias("start_time"),
        local("reported_end_date").alias("reported_end_time"), "end_flag", "report_state", "anomaly_type", "anomaly_description", "annual_anomaly", "r_value", "r0_value", "term_class", F.lit(True).alias("is_listed"), "right_censored",
        (~F.array_contains("quality_flags", "identity_incomplete")).alias("identity_complete"), F.col("quality_flags").alias("reliability_flags"), F.lit(source_id).alias("source_id"), F.col("file").alias("source_file"),
        F.col("sha256").alias("source_sha256"), F.col("sheet").alias("source_sheet"), "source_row", F.coalesce("serial", F.lit(0)).alias("source_serial_number"), F.col("report_year").alias("source_period_year"), F.col("report_period").alias("source_period"),
    )


def period_table(found: DataFrame, source_id: str) -> DataFrame:
    """One row a file, with the columns of its contract: rows in all, by sheet, and by how their dates differ."""
    named = dict(zip(("deformation", "fluid", "electromagnetic", "cross_fault"), SHEETS, strict=True))
    out = found.groupBy("file", "sha256", "report_year", "report_period", "report_date").agg(
        F.max("available_at").alias("available_at"), F.count("*").alias("row_count"), F.count_if(F.col("row_report_date") != F.col("report_date")).alias("row_report_date_mismatch_count"),
        F.count_if(F.col("row_report_date") < F.col("report_date")).alias("row_report_date_before_count"), F.count_if(F.col("row_report_date") > F.col("report_date")).alias("row_report_date_after_count"),
        *[F.count_if(F.col("sheet") == s).alias(f"{n}_row_count") for n, s in named.items()],
    )
    return out.select(stable_uuid(joined_parts(F.lit("anomaly_report"), F.col("sha256"), F.col("file"))).alias("report_id"), F.lit(source_id).alias("source_id"), F.col("file").alias("source_file"), F.col("sha256").alias("source_sha256"), *[c for c in out.columns if c not in ("file", "sha256")])


def entity_audit(found: DataFrame) -> DataFrame:
    """What a reader should look at, with the columns of its contract: anomalies whose end was changed or taken back
    from one report to the next, and observations whose entity is not resolved."""
    w = Window.partitionBy("anomaly_id").orderBy("report_date", "available_at", "observation_id")
    last = F.last("reported_end_date", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.filter("fault is null").withColumns({"__before": F.lag("reported_end_date").over(w), "__last": last})
    kind = F.when(F.col("__before").isNotNull() & F.col("reported_end_date").isNull(), "end_time_retracted").when(F.col("reported_end_date") != F.col("__last"), "end_time_revised").when(F.array_contains("quality_flags", "entity_unresolved"), "entity_unresolved")
    local = lambda c: F.to_timestamp_ntz(c)
    return marked.withColumn("audit_type", kind).filter("audit_type is not null").select(
        stable_uuid(joined_parts(F.lit("anomaly_audit"), F.col("audit_type"), F.col("observation_id"))).alias("audit_id"), "audit_type", F.lit("unreviewed").alias("status"), F.col("file").alias("source_file"), F.col("sheet").alias("source_sheet"), "report_date",
        F.array("anomaly_id").alias("anomaly_ids"), F.array("observation_id").alias("observation_ids"), F.col("quality_flags").alias("reliability_flags"), local(F.coalesce("__before", "__last")).alias("previous_reported_end_time"), local(F.col("reported_end_date")).alias("current_reported_end_time"),
    )


def ordered(found: DataFrame) -> DataFrame:
    """The total order of observations: report date, sheet, row, file, id."""
    sheet = F.array_position(F.array(*map(F.lit, SHEETS)), F.col("sheet"))
    return found.orderBy("report_date", sheet, "source_row", "file", "observation_id")


def serials_out_of_place(found: DataFrame) -> DataFrame:
    """Rows whose serial number is not their place in the sheet."""
    return serial_faults(found.select("file", "sheet", "source_row", "serial"), ["file", "sheet"], "serial")


def periods(found: DataFrame) -> DataFrame:
    """report_year, report_period, report_date, files and rows of every period."""
    return found.groupBy("report_year", "report_period").agg(F.min("report_date").alias("report_date"), F.count_distinct("file").alias("files"), F.count("*").alias("rows"))


def missing_periods(there: DataFrame) -> DataFrame:
    """report_year, report_period and expected_report_date of periods between the first and last of a year that no file
    has: a week for each period from the nearest one that is there."""
    gaps = missing_numbers(there, "report_year", "report_period")
    dates = there.select("report_year", F.col("report_period").alias("nearest"), "report_date")
    return gaps.join(dates, ["report_year", "nearest"]).select("report_year", "report_period", F.date_add("report_date", (7 * (F.col("report_period") - F.col("nearest"))).cast("int")).alias("expected_report_date"))


def revised(found: DataFrame) -> DataFrame:
    """Observations with the reports before them: an end that was taken back, or changed."""
    from tremora.operators.sequences import revisions

    return revisions(found, "anomaly_id", ["report_date", "available_at", "observation_id"], "reported_end_date")


def quality(found: DataFrame) -> DataFrame:
    """Counts of the whole domain in one row, by one aggregate."""
    counted = [F.count_if(F.array_contains("quality_flags", name)).alias(name) for name in ("row_report_date_mismatch_source", "missing_station_name", "missing_measurement", "identity_incomplete", "end_flag_inconsistent", "future_reported_end_time", "end_before_start", "manual_prediction_fields_present")]
    return found.agg(F.count("*").alias("rows"), F.count_if(F.col("fault").isNotNull()).alias("faults"), F.count_distinct("file").alias("files"), F.count_distinct("station_id").alias("stations"), F.count_distinct("anomaly_id").alias("anomalies"), F.count_if("right_censored").alias("right_censored"), F.min("report_date").alias("first_report"), F.max("report_date").alias("last_report"), F.min("start_date").alias("first_start"), *counted)


def latest(found: DataFrame) -> DataFrame:
    """The last report of each anomaly, by what was available."""
    w = Window.partitionBy("anomaly_id").orderBy(F.desc("available_at"), F.desc("report_date"), "observation_id")
    return found.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")
