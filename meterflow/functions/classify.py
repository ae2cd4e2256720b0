"""Classification of measuring points by ordered rules over code and name; rules are data, compiled to one column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of names and codes that decide each class, in order of precedence.
# A rule is (class, words of the name, parts of the code, starts of the code).
SYSTEMS = [
    ("generator", ["发电机"], ["FDJ"], ["SLG_JZ", "S_SLG_JZ"]),
    ("chiller", ["冷机"], ["LDSCS", "LDSHS"], []),
    ("boiler", ["锅炉"], ["Boiler", "BOILER"], []),
    ("cchp", ["三联供"], ["TT"], []),
    ("burner", ["燃烧机"], ["Burner"], []),
]
THEMES = [
    ("temperature", ["温度"], ["_T", "Temp"], []),
    ("power", ["功率"], ["Power"], []),
    ("pressure", ["压力"], ["_P", "Press"], []),
    ("flow", ["流量"], ["_F", "Flow"], []),
    ("status", ["运行"], ["RUN", "Run"], []),
    ("cumulative", ["累计", "电能"], ["TOTAL", "ADDH"], []),
    ("runtime", ["时间"], ["runtime", "Runtimes"], []),
    ("count", ["次数"], ["Starttimes"], []),
    ("load", ["负荷"], ["Load"], []),
]
UNITS = {"temperature": "℃", "power": "kW", "pressure": "MPa", "flow": "m³/h", "status": "bool", "cumulative": "kWh", "runtime": "hours", "count": "times", "load": "%"}
SUPPLY_WORDS, SUPPLY_CODES = ["出水温度", "供水温度"], ["LDSCS"]
RETURN_WORDS, RETURN_CODES = ["回水温度"], ["LDSHS"]
HEADER_WORDS = ["冷水", "压力"]
STATION = r"(\d+)#站"
UNIT_NUMBER = r"(\d+)#(冷机|锅炉|三联供|发电机|燃烧机)"
PLAIN_ROLES = ["pressure", "flow", "power", "status", "runtime", "count"]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def matches(name: Column, code: Column, words=(), parts=(), starts=()) -> Column:
    return any_of([name.contains(w) for w in words] + [code.contains(p) for p in parts] + [code.startswith(s) for s in starts])


def first_rule(rules: list[tuple], name: Column, code: Column, otherwise: str) -> Column:
    """The class of the first rule that applies."""
    out = F.lit(otherwise)
    for label, words, parts, starts in reversed(rules):
        out = F.when(matches(name, code, words, parts, starts), label).otherwise(out)
    return out


def station_id(name: Column) -> Column:
    number = F.regexp_extract(name, STATION, 1)
    return F.when(number != "", F.concat(F.lit("station_"), number)).otherwise("unknown")


def is_header(name: Column) -> Column:
    return name.contains(HEADER_WORDS[0]) & name.contains(HEADER_WORDS[1])


def system_type(name: Column, code: Column) -> Column:
    generator, chiller, *_ = SYSTEMS
    header = is_header(name) & ~matches(name, code, *generator[1:])
    return F.when(header, chiller[0]).otherwise(first_rule(SYSTEMS, name, code, "other"))


def equipment_id(name: Column, code: Column, system: Column) -> Column:
    number = F.regexp_extract(name, UNIT_NUMBER, 1)
    return F.when(number != "", F.concat_ws("_", system, number)).when((system == "chiller") & is_header(name), "chiller_header").otherwise(code)


def theme(name: Column, code: Column) -> Column:
    return first_rule(THEMES, name, code, "other")


def unit(theme: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), theme), F.lit("unknown"))


def measure_role(name: Column, code: Column, theme: Column) -> Column:
    temperature = theme == "temperature"
    return (
        F.when(temperature & matches(name, code, SUPPLY_WORDS, SUPPLY_CODES), "supply_temp")
        .when(temperature & matches(name, code, RETURN_WORDS, RETURN_CODES), "return_temp")
        .when(theme.isin(*PLAIN_ROLES), theme)
    )


def classify_points(points, code_col: str = "point_code", name_col: str = "point_name"):
    """Adds station_id, system_type, equipment_id, theme, unit and measure_role to a table of points."""
    code, name = F.col(code_col), F.col(name_col)
    out = points.withColumns({"station_id": station_id(name), "system_type": system_type(name, code), "theme": theme(name, code)})
    return out.withColumns({"equipment_id": equipment_id(name, code, F.col("system_type")), "unit": unit(F.col("theme")), "measure_role": measure_role(name, code, F.col("theme"))})


def system_of_equipment(equipment: Column) -> Column:
    """The system that an equipment id's start names."""
    return F.when(equipment.startswith("chiller"), "chiller").when(equipment.startswith("heating") | equipment.startswith("boiler") | equipment.startswith("burner"), "heating").when(equipment.startswith("cchp") | equipment.startswith("generator"), "cchp")
