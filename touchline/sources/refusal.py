"""Tables that are refused: all rules are counted in the pass that writes, and a table that breaks one never appears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import new_path


class Refused(ValueError):
    """broken: the rules that don't hold, and how often."""

    def __init__(self, broken: dict[str, int]):
        self.broken = broken
        super().__init__("; ".join(f"{rule}: {n}" for rule, n in broken.items()))


def write_checked(df: DataFrame, path: str, rules: dict[str, Column], least_rows: int = 0) -> dict[str, int]:
    """Write df as a new table at path, unless a row breaks a rule (a rule is what must not be; null is no breach) or there are too few rows.

    The rules are counted by observation while the rows are written aside; where all hold, the table is moved into its place at once.
    Gives the counts. A path that is there already is refused before anything runs.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new_path(spark, "aside") if "://" not in path and not path.startswith("/") else f"{path.rstrip('/')}.aside")
    files = place.getFileSystem(conf)
    if files.exists(place):
        raise FileExistsError(path)
    seen = Observation()
    counts = [F.count_if(F.coalesce(rule, F.lit(False))).alias(f"rule_{k}") for k, rule in enumerate(rules.values())]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.mode("overwrite").parquet(str(aside))
    got = seen.get
    broken = {name: got[f"rule_{k}"] for k, name in enumerate(rules) if got[f"rule_{k}"]}
    if got["rows"] < least_rows:
        broken["too few rows"] = got["rows"]
    if broken:
        files.delete(aside, True)
        raise Refused(broken)
    files.rename(aside, place)
    return {name: 0 for name in rules} | {"rows": got["rows"]}


def bad_fields(raw: str, schema: str, required: tuple[str, ...] = ()) -> Column:
    """Names of the fields of a JSON text, in the schema's order, that have a value of another type, or are required and have none; the
    name json where the text is no JSON object."""
    v = F.try_parse_json(raw)
    whole = F.try_variant_get(v, "$", "map<string, variant>")
    faults = []
    for field in StructType.fromDDL(schema).fields:
        have, typed = whole[field.name], F.try_variant_get(v, f"$.{field.name}", field.dataType.simpleString())
        absent = have.isNull() | F.is_variant_null(have)
        faults.append(F.when((~absent & typed.isNull()) | (absent if field.name in required else F.lit(False)), F.lit(field.name)))
    return F.when(whole.isNull(), F.array(F.lit("json"))).otherwise(F.array_compact(F.array(*faults)))


def refuse(df: DataFrame, faults: Column, key: Column) -> DataFrame:
    """df, which ends the job at the first row with faults, naming it and them."""
    stop = F.raise_error(F.concat(F.lit("row "), key.cast("string"), F.lit(": "), F.array_join(faults, ", ")))
    return df.where(F.when(F.size(faults) > 0, stop.cast("boolean")).otherwise(True))
