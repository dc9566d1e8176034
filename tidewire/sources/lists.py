"""Word lists, country lexicons and authority files: readers, the export of an authority and its import elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = ["language", "kind", "name"]


def read_stop_words(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(word): the different lower-case lines of text files; empty lines and comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).filter((line != "") & ~line.startswith(comment)).select(F.lower(line).alias("word")).distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(code, names) of JSON files that hold objects with these two fields, or arrays of such objects; codes without a name are left out."""
    rows = spark.read.json(path, schema="code string, names array<string>", multiLine=True)
    return rows.select(F.upper("code").alias("code"), F.array_compact("names").alias("names")).filter("code IS NOT NULL AND size(names) > 0")


def version(rows: DataFrame) -> DataFrame:
    """One row: a hash of a list's rows whatever their order, to tell whether work done with it is stale. Each row is hashed alone and the hashes are added."""
    each = F.conv(F.left(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("version"))


def export_authority(names: DataFrame, ids: DataFrame, claims: DataFrame, language: str | None = None) -> DataFrame:
    """One row a root that carries a choice: its identity and columns, `variants` (identities), `ids` (scheme, value) and `claims` (names), nested and sorted.

    `names`: entity_id, language, kind, name, authority_id, preferred, note, hidden, ambiguous. A choice is a variant, an id, a claim, a preferred name, a note or one
    of the two marks. `language` keeps roots of one. Write the result as JSON to carry it elsewhere. Nothing is shown twice: variants of variants do not occur.
    """
    roots = names.filter("authority_id IS NULL")
    if language is not None:
        roots = roots.filter(F.col("language") == language)
    nest = lambda rows, key, fields, name: rows.groupBy(F.col(key).alias("entity_id")).agg(F.array_sort(F.collect_set(F.struct(*fields) if len(fields) > 1 else F.col(fields[0]))).alias(name))
    variants = nest(names.filter("authority_id IS NOT NULL"), "authority_id", IDENTITY, "variants")
    out = roots.join(variants, "entity_id", "left").join(nest(ids, "entity_id", ["scheme", "value"], "ids"), "entity_id", "left").join(nest(claims.withColumnRenamed("name", "claim"), "root_id", ["claim"], "claims"), "entity_id", "left")
    chosen = F.col("variants").isNotNull() | F.col("ids").isNotNull() | F.col("claims").isNotNull() | F.col("preferred").isNotNull() | F.col("note").isNotNull() | F.coalesce("hidden", F.lit(False)) | F.coalesce("ambiguous", F.lit(False))
    return out.filter(chosen).select(*IDENTITY, "preferred", "note", "hidden", "ambiguous", "variants", "ids", "claims")


def import_authority(file: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names after an export is taken in: (identity, root identity, preferred, note, hidden, ambiguous), and a report (outcome, names).

    Names are told by language, kind and name, not by id. A name that is not held is created; a held one without a root and without variants becomes a variant
    of the file's root (`linked`); one that is already there is `unchanged`; one under another root, or a root with variants of its own, is `skipped`. A root of
    the file that is a variant here is skipped with all its variants. Marks and texts of the file fill what is empty here and never erase. `names`: as of `export_authority`.
    Of a name listed under several roots the first root in the alphabet takes it.
    """
    key = F.struct(*IDENTITY)
    held = names.select(key.alias("id"), "entity_id", "authority_id", "preferred", "note", "hidden", "ambiguous")
    of = held.select(F.col("entity_id").alias("authority_id"), F.col("id").alias("held_root"))
    held = held.join(of, "authority_id", "left")
    busy = held.filter("held_root IS NOT NULL").select(F.col("held_root").alias("id"), F.lit(True).alias("has_variants")).distinct()
    known = held.join(busy, "id", "left").select("id", "held_root", "preferred", "note", "hidden", "ambiguous", "has_variants", F.lit(True).alias("held"))
    roots = file.select(key.alias("root"), *[F.col(c).alias(f"f_{c}") for c in ("preferred", "note", "hidden", "ambiguous")], "variants")
    as_rows = roots.select(F.col("root").alias("id"), "root", "f_preferred", "f_note", "f_hidden", "f_ambiguous")
    of_variants = roots.select(F.explode("variants").alias("id"), "root").select(F.struct(*[F.col(f"id.{c}").alias(c) for c in IDENTITY]).alias("id"), "root").filter("id <> root")
    first = of_variants.join(as_rows.select("id"), "id", "left_anti").groupBy("id").agg(F.min("root").alias("root"))
    wanted = as_rows.unionByName(first, allowMissingColumns=True).join(known, "id", "left")
    off = known.filter("held_root IS NOT NULL").select(F.col("id").alias("root"), F.lit(True).alias("root_is_variant"))
    wanted = wanted.join(off, "root", "left")
    own = F.col("id") == F.col("root")
    outcome = (
        F.when(F.col("root_is_variant"), "skipped").when(F.col("held").isNull(), "created").when(own, "unchanged").when(F.col("held_root") == F.col("root"), "unchanged")
        .when(F.col("held_root").isNotNull() | F.col("has_variants"), "skipped").otherwise("linked")
    )
    judged = wanted.withColumn("outcome", outcome)
    done = judged.filter("outcome <> 'skipped'").select("id", "root", *[F.coalesce(c, f"f_{c}").alias(c) for c in ("preferred", "note")], *[(F.coalesce(c, F.lit(False)) | F.coalesce(f"f_{c}", F.lit(False))).alias(c) for c in ("hidden", "ambiguous")])
    rest = known.join(done.select("id"), "id", "left_anti").select("id", F.coalesce("held_root", "id").alias("root"), "preferred", "note", F.coalesce("hidden", F.lit(False)).alias("hidden"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
    return done.unionByName(rest), judged.groupBy("outcome").agg(F.count("*").alias("names"))
