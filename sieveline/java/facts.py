"""Java files as DataFrames: files, types and methods with the facts that metrics are computed from, and those metrics.

Files are scanned whole, one per row, in a map: a file that can't be read or decoded takes nothing else with it.
Everything after that is DataFrame work: which accesses are a class's own or foreign is array algebra over its fields
and the set of the project's types, which is joined, as a project's types grow with its sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.java.shapes import column, shapes_of

#: Folders that never hold sources, and those that do only below a folder named src.
NEVER, OUTPUT, ROOT = (".git", "node_modules", ".idea", ".venv"), ("target", "build", "out", "bin"), "src"
# Types that every class touches, which coupling leaves out.
IGNORED_TYPES = (
    "void int long short byte char boolean float double Integer Long Short Byte Character Boolean Float Double String StringBuilder Object Number Math System Class "
    "List ArrayList Map HashMap Set HashSet Collection Optional Stream Exception RuntimeException Throwable Error Iterator Iterable Comparable Runnable Thread T E K V R U"
).split()
ACCESSORS = "^(get|set|is|has)"

_PAIR = "array<struct<receiver:string,member:string>>"
_METHOD = f"""struct<name:string,return_type:string,parameters:array<struct<name:string,type_name:string>>,modifiers:array<string>,start_line:int,end_line:int,is_constructor:boolean,
cc:int,nesting:int,mloc:int,declared_locals:array<string>,local_types:map<string,string>,names:array<string>,this_accesses:array<string>,field_accesses:{_PAIR},qualified_calls:{_PAIR},calls:array<string>,types:array<string>>"""
_TYPE = f"struct<name:string,kind:string,modifiers:array<string>,superclass:string,interfaces:array<string>,start_line:int,end_line:int,loc:int,fields:array<struct<name:string,type_name:string,modifiers:array<string>,line:int>>,methods:array<{_METHOD}>>"
UNITS = f"file string, package string, imports array<string>, effective_loc int, has_syntax_errors boolean, types array<{_TYPE}>".replace("\n", " ")


#: The parts that counts of methods, decisions and lines are made of, and those that foreign accesses are.
SIZES = "file string, package string, has_syntax_errors boolean, types array<struct<name:string,methods:array<struct<cc:int,nesting:int,mloc:int>>>>"
ACCESSES = f"file string, package string, has_syntax_errors boolean, types array<struct<name:string,fields:array<struct<name:string,type_name:string>>,methods:array<struct<local_types:map<string,string>,field_accesses:{_PAIR},qualified_calls:{_PAIR}>>>>"


def java_files(spark: SparkSession, root: str) -> DataFrame:
    """file, content of every Java file under `root`, but for folders that hold none of the sources."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(root)
    parts = F.split(F.regexp_replace("path", "^[a-z]+:/*", ""), "/")
    depth = F.size(F.split(F.lit(root.split(":", 1)[-1].strip("/")), "/"))
    folders = F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth - 1, F.lit(0)))
    source = F.array_position(folders, ROOT)
    before = F.when(source > 0, F.slice(folders, F.lit(1), source.cast("int") - 1)).otherwise(folders)
    kept = ~F.arrays_overlap(folders, F.array(*map(F.lit, NEVER))) & ~F.arrays_overlap(before, F.array(*map(F.lit, OUTPUT)))
    return read.where(kept).select(F.array_join(F.slice(parts, depth + 1, F.size(parts)), "/").alias("file"), "content")


def units(files: DataFrame, parts: str = UNITS) -> DataFrame:
    """A row per file (file, content: bytes or text): package, imports, lines, errors, and its types with their methods; of these, the `parts` named."""
    schema = pa.schema(_arrow(parts))
    of = pa.struct([f for f in schema if f.name != "file"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = shapes_of(of)
        for batch in batches:
            found = column(of, [shapes.values((c or b"").decode("utf-8", "replace")) for c in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.flatten()], schema=schema)

    return files.select(F.col("file").cast("string").alias("file"), F.col("content").cast("binary").alias("content")).mapInArrow(scanned, parts)


def _arrow(parts: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(parts))


def entities(scanned: DataFrame) -> DataFrame:
    """A row per type, in source order within its file (`position`)."""
    return scanned.select("file", "package", "has_syntax_errors", F.posexplode("types").alias("position", "type")).select("file", "package", "has_syntax_errors", "position", "type.*").withColumn("class_id", F.xxhash64("file", "position"))


def _has(modifiers: Column, name: str) -> Column:
    return F.array_contains(modifiers, name)


def _typed(of: Callable[[str], Column], field_types: Column, class_name: Column) -> Column:
    """A method's accesses to other classes, with the receivers' types; `of` has its parts by name."""
    candidates = F.array_union(of("field_accesses"), F.filter(of("qualified_calls"), lambda c: c["member"].rlike(ACCESSORS)))

    def receiver_type(receiver: Column) -> Column:
        word = receiver.rlike("^[\\p{L}_$][\\p{L}\\p{N}_$]*$")
        return F.when(word, F.coalesce(F.try_element_at(of("local_types"), receiver), F.try_element_at(field_types, receiver), F.when(F.upper(F.substring(receiver, 1, 1)) == F.substring(receiver, 1, 1), F.when(F.substring(receiver, 1, 1).rlike("\\p{Lu}"), receiver))))

    typed = F.transform(candidates, lambda c: F.struct(receiver_type(c["receiver"]).alias("receiver"), c["member"].alias("member")))
    return F.array_distinct(F.filter(typed, lambda c: c["receiver"].isNotNull() & (c["receiver"] != class_name)))


def _field_types() -> Column:
    """The first type of each name of a field."""
    return F.map_from_entries(F.transform(F.array_distinct("fields.name"), lambda n: F.struct(n, F.get(F.transform(F.filter("fields", lambda f: f["name"] == n), lambda f: f["type_name"]), 0))))


def foreign_counts(types: DataFrame) -> DataFrame:
    """Per name of a class with methods: these, and their foreign accesses if the project's types are known (`in_project`), and if not (`alone`), as `methods` has them.

    Files are scanned once: what a class declares and what it accesses, counted by receivers, come from one table.
    """
    rows = types.select("name", "methods", "fields", _field_types().alias("field_types"))
    receivers = F.flatten(F.transform("methods", lambda m: F.transform(_typed(lambda part: m[part], F.col("field_types"), F.col("name")), lambda c: c["receiver"])))
    # A row for the class itself, without a receiver, and one for each access.
    rows = rows.select("name", F.size("methods").alias("methods"), F.explode(F.concat(F.array(F.lit(None).cast("string")), receivers)).alias("receiver"))
    counted = rows.groupBy("name", "receiver").agg(F.sum(F.when(F.col("receiver").isNull(), F.col("methods")).otherwise(1)).alias("n"))
    counted = counted.checkpoint() if types.sparkSession.sparkContext.getCheckpointDir() else counted.persist()
    declared, accessed = counted.where("receiver is null"), counted.where("receiver is not null")
    alone = accessed.where(~F.col("receiver").isin(*IGNORED_TYPES)).groupBy("name").agg(F.sum("n").alias("alone"))
    known = accessed.join(declared.select(F.col("name").alias("receiver")), "receiver", "left_semi").groupBy("name").agg(F.sum("n").alias("in_project"))
    out = declared.where("n > 0").select("name", F.col("n").alias("methods")).join(known, "name", "left").join(alone, "name", "left")
    return out.select(F.col("name").alias("class_name"), "methods", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_project", "alone")])


def methods(types: DataFrame, known: bool = True) -> DataFrame:
    """A row per method with its own and foreign accesses, in the columns that metrics and strategies read.

    With `known`, an access is foreign if its receiver's type is one of the project's; else if it isn't an ignored one.
    """
    rows = types.select("class_id", "file", F.col("name").alias("class_name"), F.col("fields.name").alias("field_names"), _field_types().alias("field_types"), F.posexplode("methods").alias("i", "m"))
    rows = rows.select("class_id", "file", "class_name", "field_names", "field_types", F.col("i").cast("long").alias("i"), "m.*")
    own = F.array_union(F.array_intersect(F.array_except("names", "declared_locals"), "field_names"), F.array_intersect("this_accesses", "field_names"))
    rows = rows.withColumn("own", own).withColumn("typed", _typed(F.col, F.col("field_types"), F.col("class_name")))
    if known:
        project = types.select(F.col("name").alias("receiver")).distinct()
        wanted = rows.select("class_id", "i", F.explode("typed").alias("x")).withColumn("receiver", F.col("x.receiver")).join(project, "receiver", "left_semi").groupBy("class_id", "i").agg(F.sort_array(F.collect_list("x")).alias("foreign"))
        rows = rows.join(wanted, ["class_id", "i"], "left").withColumn("foreign", F.coalesce("foreign", F.filter("typed", lambda c: F.lit(False))))
    else:
        rows = rows.withColumn("foreign", F.filter("typed", lambda c: ~c["receiver"].isin(*IGNORED_TYPES)))
    receivers = F.array_distinct(F.transform(F.concat("field_accesses", "qualified_calls"), lambda c: c["receiver"]))
    called = F.array_union("calls", F.transform("qualified_calls", lambda c: F.concat(c["receiver"], F.lit("."), c["member"])))
    return rows.select(
        "class_id", "file", "class_name", "i", "name", "start_line", "end_line", F.col("cc").cast("long").alias("cc"), F.col("mloc").cast("long").alias("mloc"), F.size("parameters").cast("long").alias("np"), F.col("nesting").cast("long").alias("nesting"),
        F.size("declared_locals").cast("long").alias("locals"), _has(F.col("modifiers"), "public").alias("public"), _has(F.col("modifiers"), "static").alias("static"), F.col("is_constructor").alias("ctor"),
        (~F.col("is_constructor") & F.col("name").rlike(ACCESSORS) & (F.col("end_line") - F.col("start_line") <= 3)).alias("accessor"), "own", "foreign", called.alias("calls"), F.col("types"),
        (F.size(receivers) + F.size("calls")).cast("long").alias("receivers_and_calls"),
    )


def fields(types: DataFrame) -> DataFrame:
    f = types.select("class_id", F.explode("fields").alias("f"))
    return f.select("class_id", F.col("f.name").alias("field"), _has(F.col("f.modifiers"), "public").alias("public"), (_has(F.col("f.modifiers"), "static") & _has(F.col("f.modifiers"), "final")).alias("constant"))


def classes(types: DataFrame) -> DataFrame:
    """class_id, name, kind and the rest that strategies read; `superclass` is the id of the last type of that name, or a stand-in for one outside."""
    last = types.select("name", "class_id", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("file"), F.desc("position"))).alias("n")).where("n = 1").select(F.col("name").alias("superclass"), F.col("class_id").alias("parent"))
    joined = types.select("class_id", "file", "name", "package", "kind", "start_line", "end_line", "loc", "superclass").join(last, "superclass", "left")
    return joined.select("class_id", "file", "name", "package", "kind", "start_line", "end_line", F.col("loc").cast("long").alias("loc"), F.when(F.col("superclass").isNotNull(), F.coalesce("parent", F.xxhash64("superclass"))).alias("superclass"))


def coupling(types: DataFrame, of: DataFrame) -> DataFrame:
    """CBO: distinct types that a class names, without itself and the ignored ones."""
    named = types.select("class_id", "name", F.explode(F.array_compact(F.flatten(F.array(F.array("superclass"), "interfaces", "fields.type_name")))).alias("type"))
    used = of.select("class_id", F.col("class_name").alias("name"), F.explode(F.concat("types", F.transform("foreign", lambda x: x["receiver"]))).alias("type"))
    kept = named.unionByName(used).where((F.col("type") != F.col("name")) & ~F.col("type").isin(*IGNORED_TYPES))
    return types.select("class_id").join(kept.groupBy("class_id").agg(F.countDistinct("type").alias("cbo")), "class_id", "left").select("class_id", F.coalesce("cbo", F.lit(0)).alias("cbo"))
