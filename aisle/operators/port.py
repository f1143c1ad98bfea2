"""Port operations: meters, containers, rosters and yard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions import ordered
from aisle.functions.listing import page, top_k
from aisle.functions.scalars import round_to, safe_div

RATE = 0.85
# Status after an event; inspection changes nothing.
EVENT_STATUS = {
    "vessel_arrival": "arrived",
    "discharge": "arrived",
    "gate_in": "arrived",
    "stack": "stacked",
    "restack": "stacked",
    "retrieve": "retrieving",
    "load": "departed",
    "gate_out": "departed",
}
MOVES = ["discharge", "load"]
GATE_MOVES = ["discharge", "load", "gate_in", "gate_out"]
PEOPLE_PER_BUCKET = 10000
SHIFTS_PER_BUCKET = 1000


def _between(df: DataFrame, col: str, start: str | None, end: str | None) -> DataFrame:
    if start:
        df = df.where(F.col(col) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(col) <= F.lit(end).cast("timestamp_ntz"))
    return df


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of the nearest whole second."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return (F.floor((micros + 500000) / 1000000) * 1000).cast("long")


def _devices(equipment: DataFrame, *columns: str) -> DataFrame:
    return equipment.select(F.col("id").alias("equipment_id"), *columns)


def energy_history(readings: DataFrame, equipment: DataFrame, equipment_id=None, start=None, end=None, limit: int = 500) -> DataFrame:
    """Newest readings with device attributes; devices are joined after the cut."""
    rows = _between(readings, "reading_time", start, end)
    if equipment_id is not None:
        rows = rows.where(F.col("equipment_id") == equipment_id)
    known = rows.join(_devices(equipment), "equipment_id", "left_semi")
    newest = top_k(known, [F.desc("reading_time"), F.asc("id")], limit)
    return newest.join(_devices(equipment, "equipment_code", "equipment_type"), "equipment_id").select(
        newest["id"], "equipment_id", "equipment_code", "equipment_type",
        epoch_ms(F.col("reading_time")).alias("ts"), "power_kw", F.col("energy_kwh").alias("delta_kwh"),
        F.col("operational_state").alias("state"),
    )


def energy_cost_summary(readings: DataFrame, equipment: DataFrame, start=None, end=None) -> DataFrame:
    """kWh, power and cost per device; devices without readings stay with zeros."""
    facts = _between(readings, "reading_time", start, end).groupBy("equipment_id").agg(
        F.sum("energy_kwh").alias("_kwh"), F.avg("power_kw").alias("_avg"),
        F.max("power_kw").alias("_max"), F.count(F.lit(1)).alias("_n"),
    )
    kwh = round_to(F.coalesce("_kwh", F.lit(0.0)), 4)
    return (
        _devices(equipment, "equipment_code", "equipment_type", F.col("name").alias("equipment_name"))
        .join(facts, "equipment_id", "left")
        .select(
            "equipment_id", "equipment_code", "equipment_type", "equipment_name",
            kwh.alias("total_kwh"),
            round_to(F.coalesce("_avg", F.lit(0.0)), 2).alias("avg_power_kw"),
            round_to(F.coalesce("_max", F.lit(0.0)), 2).alias("peak_power_kw"),
            F.coalesce("_n", F.lit(0)).alias("sample_count"),
            round_to(kwh * RATE, 2).alias("cost"),
        )
    )


def power_peaks(readings: DataFrame, equipment: DataFrame, n: int = 20, equipment_id=None) -> DataFrame:
    rows = readings.join(_devices(equipment), "equipment_id", "left_semi")
    if equipment_id is not None:
        rows = rows.where(F.col("equipment_id") == equipment_id)
    peaks = top_k(rows, [F.desc("power_kw"), F.asc("id")], n)
    return peaks.join(_devices(equipment, "equipment_code", "equipment_type"), "equipment_id").select(
        peaks["id"], "equipment_id", "equipment_code", "equipment_type", F.col("power_kw").alias("peak_power_kw"),
        epoch_ms(F.col("reading_time")).alias("ts"), F.col("operational_state").alias("state"),
    )


def event_status(event_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EVENT_STATUS.items() for x in pair])
    return F.try_element_at(table, event_type)


def state_aggregates() -> list[Column]:
    """Newest status and key times of a container; order is event time, so late rows do no harm."""
    status = event_status(F.col("event_type"))
    at = F.when(status.isNotNull(), F.struct("event_time", "event_id"))
    return [
        F.coalesce(F.max_by(status, at), F.lit("en_route")).alias("status"),
        F.max(F.when(F.col("event_type") == "vessel_arrival", F.col("event_time"))).alias("arrival_time"),
        F.max(F.when(status == "departed", F.col("event_time"))).alias("departure_time"),
    ]


def container_state(events: DataFrame) -> DataFrame:
    return events.groupBy("container_id").agg(*state_aggregates())


def container_trace(events: DataFrame, equipment: DataFrame, container_id=None) -> DataFrame:
    rows = events if container_id is None else events.where(F.col("container_id") == container_id)
    named = rows.join(
        _devices(equipment, "equipment_code", F.col("name").alias("equipment_name")), "equipment_id", "left"
    )
    return named.orderBy("container_id", "event_time", "event_id")


def container_stats(states: DataFrame, now: str) -> DataFrame:
    """Containers by status and mean hours in the yard; open stays count up to ``now``."""
    moment = F.lit(now).cast("timestamp")
    left = F.coalesce(F.col("departure_time").cast("timestamp"), moment)
    hours = (F.unix_micros(left) - F.unix_micros(F.col("arrival_time").cast("timestamp"))) / 3600e6
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return states.agg(
        F.count(F.lit(1)).alias("total_containers"), n("en_route"), n("stacked"), n("departed"),
        round_to(F.coalesce(F.avg(hours), F.lit(0.0)), 1).alias("avg_dwell_hours"),
    )


def search_containers(
    containers: DataFrame, keyword=None, vessel=None, status=None, start=None, end=None, page_no: int = 1, size: int = 20
) -> DataFrame:
    """Exact code when the keyword starts with four letters, else a prefix of code or bill of lading."""
    rows = containers
    if keyword:
        clean = keyword.strip().upper()
        if len(clean) >= 4 and clean[:4].isalpha():
            rows = rows.where(F.col("container_code") == clean)
        else:
            rows = rows.where(
                F.col("container_code").startswith(keyword) | F.col("bill_of_lading").startswith(keyword)
            )
    if vessel:
        rows = rows.where(F.col("vessel_name").contains(vessel))
    if status:
        rows = rows.where(F.col("status") == status)
    rows = _between(rows, "arrival_time", start, end)
    return page(rows, [F.desc("created_at"), F.asc("container_id")], page_no, size)


def shift_slots(shifts: DataFrame) -> DataFrame:
    """Demand of each shift and position, with the demand of the shifts before it.

    ``required_positions`` is a JSON map; single quotes are accepted.
    """
    need = F.from_json("required_positions", "map<string,int>", {"allowSingleQuotes": "true"})
    rows = shifts.select(F.col("id").alias("shift_id"), "shift_name", F.explode(need).alias("position", "need"))
    rows = rows.withColumn("_bucket", F.floor(F.col("shift_id") / SHIFTS_PER_BUCKET))
    upto = ordered.running_sum(rows, ["position"], "_bucket", [F.col("shift_id")], F.col("need"), "_upto")
    return upto.withColumn("before", F.col("_upto") - F.col("need")).drop("_upto", "_bucket")


def _staff(people: DataFrame, load: DataFrame) -> DataFrame:
    """Active people with their load so far."""
    return (
        people.where("is_active")
        .select(F.col("id").alias("personnel_id"), "position")
        .join(load.select("personnel_id", "shift_count"), "personnel_id", "left")
        .select("personnel_id", "position", F.coalesce("shift_count", F.lit(0)).cast("long").alias("_load"))
    )


def _slots(demand: DataFrame) -> DataFrame:
    """One row per person wanted, numbered through the shifts of a position."""
    return demand.where(F.col("need") > 0).withColumn(
        "slot", F.explode(F.sequence((F.col("before") + 1).cast("long"), (F.col("before") + F.col("need")).cast("long")))
    )


def _shortage(demand: DataFrame, staff: DataFrame) -> DataFrame:
    """Shifts that are not filled; the same on every day, as everybody may work once a day."""
    heads = staff.groupBy("position").agg(F.count(F.lit(1)).alias("_heads"))
    short = demand.join(heads, "position", "left").withColumn("_heads", F.coalesce("_heads", F.lit(0)))
    free = F.col("_heads") - F.col("before")
    return short.where((free <= 0) | (free < F.col("need"))).select(
        "shift_id", "position", F.when(free <= 0, "no_eligible").otherwise("understaffed").alias("constraint_type"),
        "need", F.greatest(free, F.lit(0)).alias("available"),
    )


def assign_day(people: DataFrame, shifts: DataFrame, load: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """Roster of one day and its gaps: the least loaded people fill the shifts in order.

    Everybody works once a day, so the n-th person of a position takes the n-th
    slot. People are numbered in buckets of load and id, slots are listed, and the
    two meet by equality.
    """
    return assign_horizon(people, shifts, load, day, 1)


def _water_levels(staff: DataFrame, demand: DataFrame, days: int) -> DataFrame:
    """For each position and day the load up to which people have been filled, and how many turns at that load are taken.

    A person of load L has turns at the loads L, L + 1, ..., one a day. Taking the least loaded people every day
    takes, up to day d, the d times as many least turns among everybody's first d; where that cut
    falls is read off the number of people per load.
    """
    loads = staff.groupBy("position", "_load").agg(F.count(F.lit(1)).alias("_people"))
    heads = loads.groupBy("position").agg(F.sum("_people").alias("_heads"), F.min("_load").alias("_low"), F.max("_load").alias("_high"))
    wanted = demand.where(F.col("need") > 0).groupBy("position").agg(F.sum("need").alias("_need"))
    goals = heads.join(wanted, "position").select(
        "position", "_low", "_high", F.least("_need", "_heads").alias("_daily"), F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_day")
    )
    levels = goals.withColumn("_level", F.explode(F.sequence("_low", F.col("_high") + days)))
    turns = F.least(F.col("_day").cast("long"), F.greatest(F.lit(0), F.col("_level") - F.col("_load") + 1))
    at_level = F.col("_load").between(F.col("_level") - F.col("_day") + 1, F.col("_level"))
    filled = levels.join(loads, "position").groupBy("position", "_day", "_level", "_daily").agg(
        F.sum(F.col("_people") * turns).alias("_upto"), F.sum(F.when(at_level, F.col("_people")).otherwise(0)).alias("_here")
    )
    goal = F.col("_daily") * F.col("_day")
    cut = filled.where(F.col("_upto") >= goal).groupBy("position", "_day").agg(
        F.min(F.struct("_level", (goal - F.col("_upto") + F.col("_here")).alias("_taken"))).alias("_cut")
    )
    return cut.select("position", "_day", "_cut.*")


def assign_horizon(
    people: DataFrame, shifts: DataFrame, load: DataFrame, start: str, days: int
) -> tuple[DataFrame, DataFrame]:
    """Day rosters and gaps of a horizon; each day's work adds to the load of the next.

    All days come from one plan: how often each person has worked by each day follows from the water level
    of the position, and whoever has one turn more than the day before works that day.
    """
    staff, demand = _staff(people, load), shift_slots(shifts)
    level, taken, loaded = F.col("_level"), F.col("_taken"), F.col("_load")
    turns = staff.join(_water_levels(staff, demand, days), "position").withColumn("_bucket", F.floor(F.col("personnel_id") / PEOPLE_PER_BUCKET))
    at_level = loaded.between(level - F.col("_day") + 1, level)
    turns = ordered.running_sum(turns, ["position", "_day"], "_bucket", [F.col("personnel_id")], at_level.cast("long"), "_rank")
    worked = F.least(F.col("_day").cast("long"), F.greatest(F.lit(0), level - loaded)) + (at_level & (F.col("_rank") <= taken)).cast("long")
    by_day = Window.partitionBy("personnel_id").orderBy("_day")
    turns = turns.withColumn("_worked", worked).withColumn("_before", F.coalesce(F.lag("_worked").over(by_day), F.lit(0)))
    workers = turns.where(F.col("_worked") > F.col("_before")).select(
        "position", "_day", "personnel_id", F.struct((loaded + F.col("_before")).alias("load"), F.col("_bucket").alias("ids")).alias("_bucket")
    )
    ranked = ordered.position(workers, ["position", "_day"], "_bucket", [F.col("personnel_id")], "slot")
    day = F.date_add(F.lit(start).cast("date"), F.col("_day") - 1).alias("schedule_date")
    roster = _slots(demand).join(ranked, ["position", "slot"]).select(day, "shift_id", "personnel_id", "position")
    gaps = _shortage(demand, staff).withColumn("_day", F.explode(F.sequence(F.lit(1), F.lit(days)))).select(
        day, "shift_id", "position", "constraint_type", "need", "available"
    )
    return roster, gaps


def recent_load(schedules: DataFrame, as_of: str) -> DataFrame:
    """Shifts worked or under way per person in the last seven days."""
    rows = schedules.where(
        (F.col("schedule_date") >= F.date_sub(F.lit(as_of).cast("date"), 7))
        & ~F.col("status").isin("cancelled", "planned")
    )
    return rows.groupBy("personnel_id").agg(F.count(F.lit(1)).alias("shift_count"))


def task_load(people: DataFrame, schedules: DataFrame, as_of: str) -> DataFrame:
    today = F.lit(as_of).cast("date")
    facts = schedules.groupBy("personnel_id").agg(
        F.count_if(F.col("status") == "active").alias("active_tasks"),
        F.count_if(F.col("schedule_date") == today).alias("today_shifts"),
        F.count_if(F.col("schedule_date") >= F.date_sub(today, 7)).alias("week_shifts"),
    )
    staff = people.where("is_active").select(F.col("id").alias("personnel_id"), "name", "position")
    return staff.join(facts, "personnel_id", "left").fillna(0, ["active_tasks", "today_shifts", "week_shifts"])


def roster(schedules: DataFrame, shifts: DataFrame, people: DataFrame, start=None, end=None) -> DataFrame:
    rows = schedules
    if start:
        rows = rows.where(F.col("schedule_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("schedule_date") <= F.lit(end).cast("date"))
    return rows.join(shifts.select(F.col("id").alias("shift_id"), "shift_name"), "shift_id").join(
        people.select(F.col("id").alias("personnel_id"), F.col("name").alias("personnel_name"), "position"), "personnel_id"
    )


def violations(log: DataFrame, people: DataFrame, start=None, end=None, top: int = 100) -> DataFrame:
    rows = log
    if start:
        rows = rows.where(F.col("schedule_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("schedule_date") <= F.lit(end).cast("date"))
    newest = top_k(rows, [F.desc("created_at"), F.asc("shift_id"), F.asc("position"), F.asc("id")], top)
    return newest.join(
        people.select(F.col("id").alias("personnel_id"), F.col("name").alias("personnel_name")), "personnel_id", "left"
    )


def double_booked(schedules: DataFrame) -> DataFrame:
    """People with more than one shift on a date."""
    return schedules.groupBy("schedule_date", "personnel_id").agg(F.count(F.lit(1)).alias("shifts")).where(
        F.col("shifts") > 1
    )


def utilization(readings: DataFrame, equipment: DataFrame, start=None, end=None) -> DataFrame:
    """Share of non-idle samples and hours per device; a sample stands for a second."""
    idle = F.col("operational_state") == "idle"
    facts = _between(readings, "reading_time", start, end).groupBy("equipment_id").agg(
        F.count_if(~idle).alias("_busy"), F.count_if(idle).alias("_idle"), F.count(F.lit(1)).alias("_n")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        _devices(equipment, "equipment_code", F.col("name").alias("equipment_name"))
        .join(facts, "equipment_id", "left")
        .select(
            "equipment_code", "equipment_name",
            round_to(F.try_divide(F.col("_busy") * 100.0, F.col("_n")), 4).alias("utilization_percent"),
            round_to(zero("_busy") / 3600.0, 6).alias("operating_hours"),
            round_to(zero("_idle") / 3600.0, 6).alias("idle_hours"),
        )
    )


def throughput(events: DataFrame, now: str, days: int = 7) -> DataFrame:
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    rows = events.where(F.col("event_type").isin(MOVES) & (F.col("event_time") >= since))
    return rows.groupBy(F.to_date("event_time").alias("time_bucket")).agg(
        F.count(F.lit(1)).alias("container_count"), F.count(F.lit(1)).alias("teu_count")
    )


def port_dashboard(states: DataFrame, events: DataFrame, readings: DataFrame, equipment: DataFrame, day: str) -> DataFrame:
    midnight = F.lit(day).cast("timestamp_ntz")
    stacked = states.agg(F.count_if(F.col("status") == "stacked").alias("current_containers"))
    moves = events.where(F.col("event_time") >= midnight).agg(
        F.count_if(F.col("event_type").isin(GATE_MOVES)).alias("today_throughput")
    )
    energy = readings.where(F.col("reading_time") >= midnight).agg(
        F.coalesce(F.sum("energy_kwh"), F.lit(0.0)).alias("_kwh")
    )
    devices = equipment.agg(F.count_if(F.col("status") != "idle").alias("equipment_active"))
    joined = stacked.join(F.broadcast(moves)).join(F.broadcast(energy)).join(F.broadcast(devices))
    return joined.select(
        "current_containers", "today_throughput", round_to("_kwh", 1).alias("today_energy_kwh"),
        round_to(F.col("_kwh") * RATE, 2).alias("energy_cost"), "equipment_active",
    )


def yard_hourly(events: DataFrame, readings: DataFrame, hours: int | None = None) -> DataFrame:
    """Containers seen, moves, utilisation and kWh per hour; the newest ``hours`` if given."""
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz").alias("metric_time")
    moved = events.groupBy(hour("event_time")).agg(
        F.countDistinct("container_id").alias("total_containers"),
        F.count_if(F.col("event_type").isin(MOVES)).alias("throughput_teu"),
    )
    metered = readings.groupBy(hour("reading_time")).agg(
        round_to(F.count_if(F.col("operational_state") != "idle") * 100.0 / F.count(F.lit(1)), 4).alias("avg_utilization"),
        round_to(F.sum("energy_kwh"), 6).alias("total_energy_kwh"),
    )
    rows = moved.join(metered, "metric_time", "full_outer").fillna(
        0, ["total_containers", "throughput_teu", "avg_utilization", "total_energy_kwh"]
    )
    return top_k(rows, [F.desc("metric_time")], hours) if hours else rows


def latest_readings(readings: DataFrame) -> DataFrame:
    """Newest reading and kWh so far per device."""
    newest = F.max_by(F.struct("power_kw", "operational_state", "reading_time"), F.struct("reading_time", "id"))
    return readings.groupBy("equipment_id").agg(
        newest.alias("_r"), F.sum(F.col("power_kw").cast("decimal(18,4)")).cast("double").alias("_kw")
    ).select("equipment_id", "_r.*", (F.col("_kw") / 3600).alias("cumulative_kwh"))


def live_totals(readings: DataFrame) -> DataFrame:
    """Present power, active devices and kWh so far."""
    return latest_readings(readings).agg(
        F.round(F.sum("power_kw"), 0).cast("long").alias("total_power_kw"),
        F.count_if(F.col("operational_state") != "idle").alias("active_count"),
        round_to(F.sum("cumulative_kwh"), 2).alias("total_cumulative_kwh"),
    )


def _by_hour(readings: DataFrame) -> DataFrame:
    return readings.withColumn("_hour", F.date_trunc("hour", "reading_time"))


READING_ORDER = ("reading_time", "id")


def trend_buffer(readings: DataFrame, n: int = 300) -> DataFrame:
    """The last n readings of every device, numbered from the newest."""
    order = [F.desc(c) for c in READING_ORDER]
    return ordered.newest_rows(_by_hour(readings), ["equipment_id"], "_hour", order, n).select(
        "equipment_id", "id", "reading_time", "power_kw", F.col("position").cast("long").alias("position")
    )


def cumulative_kwh(readings: DataFrame) -> DataFrame:
    """Running kWh per device, one second of power per reading."""
    order = [F.col(c) for c in READING_ORDER]
    power = F.col("power_kw").cast("decimal(18,4)")
    summed = ordered.running_sum(_by_hour(readings), ["equipment_id"], "_hour", order, power, "_kw")
    return summed.select(
        "equipment_id", "id", "reading_time", round_to(F.col("_kw").cast("double") / 3600, 6).alias("cumulative_kwh")
    )


def sequence_gaps(ticks: DataFrame, source: str = "source_id", silence: str | None = None) -> DataFrame:
    """Ticks after which numbers are missing, with how many; none after a pause longer than ``silence`` (an interval)."""
    rows = ticks.withColumn("_hour", F.date_trunc("hour", "received_at"))
    before = ordered.lag_values(rows, [source], "_hour", [F.col("received_at"), F.col("seq")], {"seq": "previous_seq", "received_at": "previous_at"})
    missing = F.col("seq") - F.col("previous_seq") - 1
    if silence is not None:
        before = before.where(F.col("received_at") <= F.col("previous_at") + F.expr(f"interval {silence}"))
    return before.where((F.col("previous_seq") > 0) & (missing > 0)).select(
        source, "seq", "previous_seq", missing.alias("dropped"), "received_at"
    )
