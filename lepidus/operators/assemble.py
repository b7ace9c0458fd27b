"""Bringing sources together: one nested record and one prompt a species, run grids, name matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lepidus.functions import strings
from lepidus.operators.lineage import bounded


def species_records(measurements: DataFrame, colours: DataFrame, answers: DataFrame, materials: DataFrame) -> DataFrame:
    """(species_name, categories, qa, materials): each species with its categories' measurements and colours, its answers and its material.

    measurements (species_name, category, measurement struct), colours (species_name, category, pos, colour struct; the last
    by pos counts), answers (species_name, qa map), materials (species_name, locality, record map).
    """
    last = colours.groupBy("species_name", "category").agg(F.max_by("colour", "pos").alias("colour"))
    cats = measurements.join(last, ["species_name", "category"], "left").groupBy("species_name").agg(F.sort_array(F.collect_list(F.struct("category", "measurement", "colour"))).alias("categories"))
    place = materials.groupBy("species_name", F.coalesce("locality", F.lit("Unknown Locality")).alias("locality")).agg(F.collect_list("record").alias("records"))
    mats = place.groupBy("species_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("locality", F.size("records").alias("n"))))).alias("materials"))
    return cats.join(answers, "species_name", "left").join(mats, "species_name", "left")


def prompt(records: DataFrame) -> DataFrame:
    """(species_name, prompt): answers, measurements of each category to 4 decimals, localities."""
    qa = F.array_join(F.transform(F.array_sort(F.map_entries("qa")), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")
    cat = F.array_join(
        F.transform("categories", lambda c: F.concat(F.lit("- "), c["category"], F.lit(": Length "), F.coalesce(strings.fixed(c["measurement"]["length_mm"], 4), F.lit("null")), F.lit(" mm, Area "), F.coalesce(strings.fixed(c["measurement"]["area_mm2"], 4), F.lit("null")), F.lit(" mm2"), F.coalesce(F.concat(F.lit(", colour "), c["colour"]["name"]), F.lit("")))), "\n"
    )
    mat = F.array_join(F.transform(F.array_sort(F.map_entries("materials")), lambda e: F.concat(F.lit("- "), e["key"], F.lit(" ("), e["value"].cast("string"), F.lit(")"))), "\n")
    body = F.concat_ws("\n", F.concat(F.lit("Species: "), "species_name"), F.lit("Answers:"), qa, F.lit("Measurements:"), cat, F.lit("Material:"), mat)
    return records.select("species_name", body.alias("prompt"))


def instructions(texts: DataFrame, column: str, kind: str = "description") -> DataFrame:
    """``column`` within the instruction of its kind."""
    before = {"description": "Write a taxonomic description from these data:\n", "full": "Write a description, a diagnosis and the material examined from these data:\n", "key": "Write a dichotomous key to these species:\n"}[kind]
    return texts.withColumn(column, F.concat(F.lit(before), column))


def grid(images: DataFrame, questions: DataFrame, temperatures: Sequence[float], replicates: int, seed: int = 1) -> DataFrame:
    """Every image, question, temperature and replicate with its seed: a plan whose size is their product."""
    spark = images.sparkSession
    runs = spark.createDataFrame([(float(t), r, seed + r - 1) for t in temperatures for r in range(1, replicates + 1)], "temperature double, replicate int, seed int")
    return images.crossJoin(bounded(questions)).crossJoin(F.broadcast(runs))  # settings are a list in the program


def _parts(names: DataFrame, name: str, others: DataFrame, other: str) -> DataFrame:
    """(name, other): every name with the others that it contains.  Its substrings of the lengths that others have are looked up, so names meet by key."""
    lengths = others.agg(F.collect_set(F.length(other)).alias("_l"))  # lengths of names are few
    n = names.crossJoin(F.broadcast(lengths)).select(name, F.explode("_l").alias("_k")).where((F.col("_k") > 0) & (F.col("_k") <= F.length(name)))
    each = n.select(name, F.explode(F.expr(f"transform(sequence(1, length(`{name}`) - _k + 1), i -> substring(`{name}`, i, _k))")).alias(other))
    return each.distinct().join(others, other).select(name, other)


def unique_containment(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of ``left`` with the only row of ``right`` whose name equals, contains or is contained in theirs; several or none give null."""
    l_, r = left.select(a).where(F.col(a).isNotNull()).distinct(), right.select(b).where(F.col(b).isNotNull()).distinct()
    j = _parts(l_, a, r, b).select(a, b).unionByName(_parts(r, b, l_, a).select(a, b)).distinct()
    one = j.groupBy(a).agg(F.count("*").alias("_n"), F.min(b).alias(b)).where("_n = 1").drop("_n")
    return left.join(one, a, "left")


def unique_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of the keys that occur once on either side."""
    once = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")
    return once(left).join(once(right), key)


def zipped(names: DataFrame, descriptions: DataFrame, model: str = "model") -> DataFrame:
    """(model, pos, name, line): the i-th line of each model with the i-th name; models whose count differs from the names' are left out."""
    n = names.agg(F.count("*").alias("_n"))
    fit = descriptions.groupBy(model).agg(F.count("*").alias("_m")).crossJoin(n).where("_m = _n").select(model)
    return descriptions.join(fit, model, "left_semi").join(names, "pos").select(model, "pos", "name", "line")


def first_by_prefix(names: DataFrame, files: DataFrame, name: str, file: str, path: str | None = None) -> DataFrame:
    """Each name with the first file, by name (or by ``path``, which is then given), that starts with it; names without a file are left out.

    The least file of every prefix, of the lengths that names have, is an aggregate with partial sums; names then meet it by key.
    """
    path = path or file
    lengths = names.agg(F.collect_set(F.length(name)).alias("_l"))  # lengths of names are few
    each = files.crossJoin(F.broadcast(lengths)).select(F.col(file).alias("_f"), F.col(path).alias(path), F.explode("_l").alias("_k")).where(F.col("_k") <= F.length("_f"))
    first = each.groupBy(F.expr("substring(_f, 1, _k)").alias(name)).agg(F.min(path).alias(path))
    return names.join(first, name)


def answer_map(rows: DataFrame, by: Sequence[str], index: str, question: str, answer: str) -> DataFrame:
    """Map "Q<i>: text" -> answer of each group."""
    key = F.concat(F.lit("Q"), F.col(index).cast("string"), F.lit(": "), question)
    return rows.groupBy(*by).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), key.alias("k"), F.col(answer).alias("v")))), lambda s: F.struct(s["k"], s["v"]))).alias("qa"))


def with_system(chats: DataFrame, messages: str, content: str, force: bool = False) -> DataFrame:
    """Conversations with a system message first, where they have none (or in any case), and whether it was put in."""
    has = F.exists(messages, lambda m: m["role"] == "system")
    add = F.lit(True) if force else ~has
    rest = F.filter(messages, lambda m: m["role"] != "system") if force else F.col(messages)
    seed = F.array(F.struct(F.lit("system").alias("role"), F.lit(content).alias("content")))
    return chats.withColumn("modified", add).withColumn(messages, F.when(add, F.concat(seed, rest)).otherwise(F.col(messages)))


def substituted(template: Column, mark: str, value: Column) -> Column:
    return F.replace(template, F.lit(mark), value)
