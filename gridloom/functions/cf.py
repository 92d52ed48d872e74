"""Climate and forecast conventions as column expressions: time axes, roles of variables, flags, ranges, attribute text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STANDARD = {"longitude": "X", "projection_x_coordinate": "X", "grid_longitude": "X", "latitude": "Y", "projection_y_coordinate": "Y", "grid_latitude": "Y", "time": "T", "altitude": "Z", "height": "Z", "depth": "Z", "air_pressure": "Z", "model_level_number": "Z"}
NAMES = {"lon": "X", "longitude": "X", "x": "X", "lat": "Y", "latitude": "Y", "y": "Y", "time": "T", "t": "T", "lev": "Z", "level": "Z", "depth": "Z", "height": "Z", "z": "Z", "altitude": "Z"}
UNIT_AXES = {**dict.fromkeys(("degrees_north", "degree_north", "degree_n", "degrees_n"), "Y"), **dict.fromkeys(("degrees_east", "degree_east", "degree_e", "degrees_e"), "X")}
SECONDS = {"day": 86400, "hour": 3600, "min": 60, "sec": 1}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def origin_text(origin: Column) -> Column:
    """An origin with zero-padded parts: YYYY-MM-DD HH:MM:SS (missing parts are 0)."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(origin, "[TZ]", " ")), r"\s+", " ")
    date, time = F.split(F.split(clean, " ")[0], "-"), F.split(F.coalesce(F.get(F.split(clean, " "), F.lit(1)), F.lit("0:0:0")), ":")
    part = lambda a, i, n: F.lpad(F.coalesce(F.get(a, F.lit(i)), F.lit("0")), n, "0")
    second = F.lpad(F.regexp_extract(F.coalesce(F.get(time, F.lit(2)), F.lit("0")), r"^(\d+)", 1), 2, "0")
    return F.concat(part(date, 0, 4), F.lit("-"), part(date, 1, 2), F.lit("-"), part(date, 2, 2), F.lit(" "), part(time, 0, 2), F.lit(":"), part(time, 1, 2), F.lit(":"), second)


def split_units(units: Column) -> tuple[Column, Column]:
    """Unit (lower case) and origin text of '<unit> since <origin>'; anything else is null."""
    m = lambda g: F.nullif(F.regexp_extract(units, r"(?i)^\s*(\w+)\s+since\s+(.+?)\s*$", g), F.lit(""))
    return F.lower(m(1)), m(2)


def unit_seconds(unit: Column) -> Column:
    out = F.when(unit.startswith("day"), 86400).when(unit.startswith("hour"), 3600).when(unit.startswith("min"), 60).when(unit.startswith("sec"), 1)
    return out.otherwise(F.raise_error(F.concat(F.lit("no time unit: "), unit)).cast("int"))


def decode_time(value: Column, units: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Numbers on a standard-calendar time axis as text."""
    unit, origin = split_units(units)
    start = F.to_timestamp_ntz(origin_text(origin), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.date_format(start + F.make_dt_interval(secs=F.round(value * unit_seconds(unit), 6).cast("decimal(18,6)")), fmt)


def decode_360(value: Column, year: int, month: int = 1, day: int = 1) -> Column:
    """Days on a calendar of twelve months of 30 days, as YYYY-MM-DD."""
    n = F.floor(value).cast("long") + (year * 360 + (month - 1) * 30 + day - 1)
    return F.format_string("%04d-%02d-%02d", F.floor(n / 360).cast("int"), (F.floor(F.pmod(n, F.lit(360)) / 30) + 1).cast("int"), (F.pmod(n, F.lit(30)) + 1).cast("int"))


def decode_noleap(value: Column, year: int, month: int = 1, day: int = 1) -> Column:
    """Days on a calendar of 365 days a year, as YYYY-MM-DD."""
    starts = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]
    n = F.floor(value).cast("long") + (year * 365 + starts[month - 1] + day - 1)
    d = F.pmod(n, F.lit(365)).cast("int")
    m = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= d))
    return F.format_string("%04d-%02d-%02d", F.floor(n / 365).cast("int"), m, d - F.element_at(F.array(*map(F.lit, starts)), m) + 1)


def detect_axis(name: Column, attrs: Column, units: Column | None = None) -> Column:
    """X, Y, Z, T or null: from the axis attribute, standard_name, units, then the name."""
    axis = F.upper(attrs["axis"])
    unit = F.lower(F.trim(F.coalesce(units, attrs["units"]) if units is not None else attrs["units"]))
    by_unit = F.coalesce(lookup(UNIT_AXES, unit), F.when(F.contains(unit, F.lit("since")), "T"))
    return F.coalesce(F.when(axis.isin("X", "Y", "Z", "T"), axis), lookup(STANDARD, F.lower(attrs["standard_name"])), by_unit, lookup(NAMES, F.lower(F.trim(name))))


def classify(variables: DataFrame, dimensions: DataFrame) -> DataFrame:
    """name, role. variables: name, attrs MAP<STRING, STRING>; dimensions: name. Roles in a fixed order of precedence."""
    short = F.ltrim(F.col("name"), F.lit("/"))

    def tokens(attr: str, text: Column, role: str, drop: tuple[str, ...] = ()) -> DataFrame:
        t = variables.select(F.explode(F.split(F.trim(text), r"\s+")).alias("token")).filter(F.col("token") != "")
        return (t.filter(~F.col("token").isin(*drop)) if drop else t).select("token", F.lit(role).alias("role"))

    a = F.col("attrs")
    refs = variables.filter(a["bounds"].isNotNull()).select(a["bounds"].alias("token"), F.lit("bounds").alias("role"))
    refs = refs.unionByName(tokens("cell_measures", F.regexp_replace(a["cell_measures"], ":", " "), "cell_measure", ("area", "volume")))
    refs = refs.unionByName(tokens("ancillary_variables", a["ancillary_variables"], "ancillary")).unionByName(tokens("coordinates", a["coordinates"], "auxiliary_coordinate"))
    refs = refs.unionByName(dimensions.select(F.ltrim(F.col("name"), F.lit("/")).alias("token"), F.lit("coordinate").alias("role")))
    refs = refs.groupBy("token").agg(F.collect_set("role").alias("roles"))
    v = variables.withColumn("short", short)
    by_short, by_name = refs.select(F.col("token").alias("short"), F.col("roles").alias("r1")), refs.select(F.col("token").alias("name"), F.col("roles").alias("r2"))
    v = v.join(by_short, "short", "left").join(by_name, "name", "left").withColumn("r", F.concat(F.coalesce("r1", F.array().cast("array<string>")), F.coalesce("r2", F.array().cast("array<string>"))))
    has = lambda role: F.array_contains("r", role)
    role = F.coalesce(a["cf_role"], F.lit(""))
    topology = (role == "mesh_topology") | (a["topology_dimension"].isNotNull() & a["node_coordinates"].isNotNull())
    case = F.when(a["grid_mapping_name"].isNotNull(), "grid_mapping").when(has("bounds"), "bounds").when(has("cell_measure"), "cell_measure").when(has("ancillary"), "ancillary")
    case = case.when(topology, "mesh_topology").when(F.contains(role, F.lit("connectivity")), "connectivity").when(has("coordinate"), "coordinate").when(has("auxiliary_coordinate"), "auxiliary_coordinate")
    return v.select("name", case.otherwise("data").alias("role"))


def conventions(text: Column) -> Column:
    """'CF-1.8 ACDD-1.3' as a map of names to versions ('' without one)."""
    parts = F.filter(F.split(F.trim(text), r"[\s,/]+"), lambda p: p != "")
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(.*?)(?:-([\d.]+))?$", 1), F.regexp_extract(p, r"^(.*?)(?:-([\d.]+))?$", 2))))


def cell_methods(text: Column) -> Column:
    """'time: mean area: sum where land' as an array of structs: dims, method, where, over."""
    pattern = r"((?:\w+:\s*)+)(\w+)((?:\s+(?:where|over|within)\s+\w+)*)"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    opt = lambda s, k: F.nullif(F.regexp_extract(s, rf"\b{k}\s+(\w+)", 1), F.lit(""))
    return F.transform(found, lambda s: F.struct(F.trim(F.regexp_replace(F.regexp_extract(s, pattern, 1), r":\s*", " ")).alias("dims"), F.regexp_extract(s, pattern, 2).alias("method"), opt(s, "where").alias("where"), opt(s, "over").alias("over")))


def flags(value: Column, values: Column, meanings: Column, masks: Column) -> Column:
    """Meanings of a flag value by values, masks or both (arrays; null: not given); ['unknown'] if none fits."""
    unknown = F.array(F.lit("unknown"))
    n = lambda *a: F.least(*(F.size(x) for x in (meanings, *a)))
    at = lambda a, i: F.element_at(a, i)
    count = F.when(masks.isNotNull() & values.isNotNull(), n(masks, values)).when(masks.isNotNull(), n(masks)).otherwise(n(values))
    index = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))

    def hit(i: Column) -> Column:
        both = value.bitwiseAND(at(masks, i)) == at(values, i)
        return F.when(masks.isNotNull() & values.isNotNull(), both).when(masks.isNotNull(), value.bitwiseAND(at(masks, i)) != 0).otherwise(value == at(values, i))

    got = F.transform(F.filter(index, hit), lambda i: at(meanings, i))
    got = F.when(masks.isNull(), F.slice(got, 1, 1)).otherwise(got)
    return F.when(meanings.isNull() | (masks.isNull() & values.isNull()) | (F.size(got) == 0), unknown).otherwise(got)


def valid_range(value: Column, low: float | None = None, high: float | None = None, both: tuple[float, float] | None = None) -> Column:
    """Values outside of the range become null; a range given as a pair overrides the ends."""
    low, high = both if both is not None else (low, high)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.when(ok, value)


def issues(global_attrs: dict[str, str], variables: DataFrame, dimensions: DataFrame) -> DataFrame:
    """issue: texts of common faults; empty if there are none."""
    spark = variables.sparkSession
    a = F.col("attrs")
    coords = variables.withColumn("short", F.ltrim(F.col("name"), F.lit("/"))).join(dimensions.select(F.col("name").alias("short")).distinct(), "short", "left_semi")
    units = F.coalesce(a["units"], F.lit(""))
    no_units = coords.filter(units == "").select(F.concat(F.lit("coordinate "), F.col("short"), F.lit(" has no units")).alias("issue"))
    no_calendar = coords.filter(F.contains(units, F.lit("since")) & a["calendar"].isNull()).select(F.concat(F.lit("time coordinate "), F.col("short"), F.lit(" has no calendar")).alias("issue"))
    out = no_units.unionByName(no_calendar)
    if "CF-" not in (global_attrs.get("Conventions") or ""):
        out = out.unionByName(spark.createDataFrame([("Conventions doesn't name CF",)], "issue string"))
    return out


def dimension_entries(metadata: DataFrame) -> DataFrame:
    """dim, size, type code, values from keys like NETCDF_DIM_time_DEF = {size,type} and NETCDF_DIM_time_VALUES = {1,2}."""
    k = metadata.select(F.regexp_extract("key", r"^NETCDF_DIM_(.+)_(DEF|VALUES)$", 1).alias("dim"), F.regexp_extract("key", r"^NETCDF_DIM_(.+)_(DEF|VALUES)$", 2).alias("what"), F.transform(F.split(F.regexp_replace("value", r"[{}\s]", ""), ","), lambda x: x.try_cast("double")).alias("v")).filter("dim <> ''")
    pick = lambda w: F.max(F.when(F.col("what") == w, F.col("v")))
    return k.groupBy("dim").agg(F.get(pick("DEF"), F.lit(0)).cast("int").alias("size"), F.get(pick("DEF"), F.lit(1)).cast("int").alias("kind"), pick("VALUES").alias("values"))


def attribute_entries(metadata: DataFrame) -> DataFrame:
    """name, attrs map from keys like 'time#Units'; attribute names in lower case."""
    p = metadata.filter(F.contains("key", F.lit("#"))).select(F.split("key", "#", 2)[0].alias("name"), F.lower(F.split("key", "#", 2)[1]).alias("attr"), "value")
    return p.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", "value")))).alias("attrs"))


def coordinate_attrs(dim: str, geographic: bool = True) -> dict[str, str]:
    """Attributes of a coordinate variable by its dimension's name."""
    axis = NAMES.get(dim.lower())
    if axis is None:
        return {}
    if axis in "XY":
        word = "longitude" if axis == "X" else "latitude"
        if geographic:
            return {"axis": axis, "standard_name": word, "long_name": word, "units": f"degrees_{'east' if axis == 'X' else 'north'}"}
        return {"axis": axis, "standard_name": f"projection_{axis.lower()}_coordinate", "long_name": f"{axis.lower()} coordinate of projection", "units": "m"}
    return {"axis": axis} | ({"standard_name": "time", "long_name": "time"} if axis == "T" else {})


GRID_MAPPINGS = {4326: "latitude_longitude", 3857: "mercator", 3035: "lambert_azimuthal_equal_area"}


def grid_mapping(epsg: int) -> dict[str, object]:
    name = GRID_MAPPINGS.get(epsg) or ("transverse_mercator" if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760 else None)
    if name is None:
        raise ValueError(f"no grid mapping for EPSG:{epsg}")
    out: dict[str, object] = {"grid_mapping_name": name, "semi_major_axis": 6378137.0, "inverse_flattening": 298.257223563, "epsg_code": epsg}
    if name == "transverse_mercator":
        out |= {"longitude_of_central_meridian": (epsg % 100) * 6 - 183.0, "scale_factor_at_central_meridian": 0.9996, "false_easting": 500000.0, "false_northing": 0.0 if epsg < 32700 else 1e7, "latitude_of_projection_origin": 0.0}
    elif name == "lambert_azimuthal_equal_area":
        out |= {"latitude_of_projection_origin": 52.0, "longitude_of_projection_origin": 10.0, "false_easting": 4321000.0, "false_northing": 3210000.0}
    return out


def groups(parents: DataFrame) -> DataFrame:
    """path, depth of all groups below the root, breadth first. parents: path, parent (null: root). Depth is bounded by the path's length."""
    depth = F.size(F.filter(F.split("path", "/"), lambda p: p != ""))
    return parents.select("path", depth.alias("depth"))
