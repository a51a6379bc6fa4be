"""Domain tables derived from the driver's tables, for Spark and for SQL.

Each Spark function has a SQL twin: a list of common table expressions with
the same arithmetic, used by the correctness checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.functions import arrays as A
from voxlake.functions.columns import computed_once

FRAME7 = ["N", "CA", "C", "O", "CB", "CG", "SG"]


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RES = sql_list(K.RESIDUES)
TITLES = sql_list(K.TITLE_NAMES)
ATOM7 = sql_list(FRAME7)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(values, index):
    """Element of a constant list at a 0-based position."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def whole(expr: str):
    return F.expr(expr).cast("double")


# ---- atoms ----------------------------------------------------------------

def atom_rows(spark: SparkSession, d: str) -> DataFrame:
    """One atom row per line item; names may repeat inside a residue."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("structure_id"),
        F.col("l_returnflag").alias("chain_id"),
        F.expr("cast(l_orderkey % 50 as int)").alias("res_no"),
        pick(K.RESIDUES, F.expr("l_orderkey % 50 % 20")).alias("res_name"),
        pick(FRAME7, F.col("l_linenumber") - 1).alias("atom"),
        F.col("l_linenumber").alias("slot"),
        ((F.col("l_quantity") - 25.5) * 0.37).alias("x"),
        (whole("(l_partkey * 7) % 41 - 20") * 0.53).alias("y"),
        (whole("(l_orderkey * 13 + l_linenumber * 5) % 41 - 20") * 0.47).alias("z"),
        F.struct("l_orderkey", "l_partkey", "l_quantity").alias("line_no"),
    )


def atoms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct atoms: repeats collapse to the largest coordinates."""
    keys = ["structure_id", "chain_id", "res_no", "res_name", "atom", "slot"]
    one = atom_rows(spark, d).groupBy(*keys).agg(*[F.max(c).alias(c) for c in "xyz"])
    full = one.withColumns({
        "element": F.substring("atom", 1, 1),
        "line_no": (F.ascii("chain_id") * 50 + F.col("res_no")) * 8 + F.col("slot"),
    })
    # Filters stay above the generator: all branches of a plan share one exchange of the atoms.
    return full.select(F.inline(F.array(F.struct(*full.columns))))


ATOM_ROWS = f"""
atom_rows AS (
  SELECT 'S' || l_suppkey AS structure_id, l_returnflag AS chain_id,
         CAST(l_orderkey % 50 AS INTEGER) AS res_no,
         {RES}[CAST(l_orderkey % 50 % 20 AS INTEGER) + 1] AS res_name,
         {ATOM7}[l_linenumber] AS atom, l_linenumber AS slot,
         (l_quantity - 25.5e0) * 0.37e0 AS x,
         CAST((l_partkey * 7) % 41 - 20 AS DOUBLE) * 0.53e0 AS y,
         CAST((l_orderkey * 13 + l_linenumber * 5) % 41 - 20 AS DOUBLE) * 0.47e0 AS z,
         l_orderkey, l_partkey, l_quantity
  FROM lineitem)"""
ATOMS = ATOM_ROWS + """,
atoms AS (
  SELECT structure_id, chain_id, res_no, res_name, atom, slot,
         max(x) AS x, max(y) AS y, max(z) AS z, substring(atom, 1, 1) AS element,
         (ascii(chain_id) * 50 + res_no) * 8 + slot AS line_no
  FROM atom_rows GROUP BY ALL)"""
FRAMES = ATOMS + f""",
res AS (
  SELECT structure_id, chain_id, res_no, res_name,
         list_position({RES}, res_name) - 1 AS label,
         max(x) FILTER (atom = 'N') AS nx, max(y) FILTER (atom = 'N') AS ny, max(z) FILTER (atom = 'N') AS nz,
         max(x) FILTER (atom = 'CA') AS rx, max(y) FILTER (atom = 'CA') AS ry, max(z) FILTER (atom = 'CA') AS rz,
         max(x) FILTER (atom = 'C') AS cx, max(y) FILTER (atom = 'C') AS cy, max(z) FILTER (atom = 'C') AS cz,
         max(x) FILTER (atom = 'CB') AS bx, max(y) FILTER (atom = 'CB') AS by_, max(z) FILTER (atom = 'CB') AS bz
  FROM atoms GROUP BY ALL),
f1 AS (SELECT *, nx - rx AS ax, ny - ry AS ay, nz - rz AS az, cx - rx AS ex, cy - ry AS ey, cz - rz AS ez
       FROM res WHERE nx IS NOT NULL AND rx IS NOT NULL AND cx IS NOT NULL),
f2 AS (SELECT *, ay * ez - az * ey AS px, az * ex - ax * ez AS py, ax * ey - ay * ex AS pz FROM f1),
f3 AS (SELECT *, CASE WHEN label <> 18 AND bx IS NOT NULL
                      THEN sign((bx - rx) * px + (by_ - ry) * py + (bz - rz) * pz) ELSE 1 END AS s FROM f2),
f4 AS (SELECT *, px * s AS wx0, py * s AS wy0, pz * s AS wz0 FROM f3),
f5 AS (SELECT *, wy0 * az - wz0 * ay AS vx0, wz0 * ax - wx0 * az AS vy0, wx0 * ay - wy0 * ax AS vz0 FROM f4),
f6 AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS nu, sqrt(vx0 * vx0 + vy0 * vy0 + vz0 * vz0) AS nv,
              sqrt(wx0 * wx0 + wy0 * wy0 + wz0 * wz0) AS nw FROM f5),
frames AS (SELECT *, ax / nu AS ux, ay / nu AS uy, az / nu AS uz, vx0 / nv AS vx, vy0 / nv AS vy, vz0 / nv AS vz,
                  wx0 / nw AS wx, wy0 / nw AS wy, wz0 / nw AS wz FROM f6 WHERE least(nu, nv, nw) > 0)"""


def boxed(own: str = "a.chain_id = f.chain_id AND a.res_no = f.res_no", channel: str = "['O','C','N','S']",
          token: str = "a.element", bias=(0.0, 0.0, 0.0), source: str = "frames") -> str:
    """SQL of the box join over ``frames`` and ``atoms``."""
    b = [f"{v!r}e0" for v in bias]
    return f""",
near AS (
  SELECT f.structure_id, f.chain_id, f.res_no, f.res_name, list_position({channel}, {token}) - 1 AS ch,
         (a.x - f.rx) * f.ux + (a.y - f.ry) * f.uy + (a.z - f.rz) * f.uz - ({b[0]}) AS tx,
         (a.x - f.rx) * f.vx + (a.y - f.ry) * f.vy + (a.z - f.rz) * f.vz - ({b[1]}) AS ty,
         (a.x - f.rx) * f.wx + (a.y - f.ry) * f.wy + (a.z - f.rz) * f.wz - ({b[2]}) AS tz
  FROM {source} f JOIN atoms a ON a.structure_id = f.structure_id AND NOT ({own})
  WHERE list_position({channel}, {token}) IS NOT NULL),
voxels AS (
  SELECT structure_id, chain_id, res_no, res_name, ch,
         least(CAST(floor(tx + 10) AS INTEGER), 19) AS ix, least(CAST(floor(ty + 10) AS INTEGER), 19) AS iy,
         least(CAST(floor(tz + 10) AS INTEGER), 19) AS iz, CAST(count(*) AS DOUBLE) AS v
  FROM near WHERE tx > -10 AND tx < 10 AND ty > -10 AND ty < 10 AND tz > -10 AND tz < 10 GROUP BY ALL)"""


BOXED = FRAMES + boxed()


# ---- fixed-width lines ----------------------------------------------------

def padded(text, width: int):
    """Text as ``%{width}s`` gives it: on the right for a negative width, never cut, 'null' for NULL."""
    text = F.coalesce(text, F.lit("null"))
    blanks = F.repeat(F.lit(" "), abs(width) - F.length(text))
    return F.concat(blanks, text) if width > 0 else F.concat(text, blanks)


def coordinate(x):
    """A double as ``%8.3f`` gives it; the formatter itself takes what no decimal holds: signed zeros, NULL, NaN, huge values."""
    plain = F.when(F.abs(x).between(0.001, 1e15), x.cast("decimal(19,3)").cast("string"))
    return F.coalesce(padded_number(plain), F.format_string("%8.3f", x))


def padded_number(text):
    return F.concat(F.repeat(F.lit(" "), 8 - F.length(text)), text)


def structure_text(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-width lines written from line items, with an early model end."""
    li = table(spark, d, "lineitem")
    rows = li.groupBy("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no")).agg(
        *[F.max(c).alias(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")]
    )
    record = F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40), "HETATM").otherwise("ATOM")
    altloc = F.when(F.expr("l_orderkey % 5 = 0"), "A").when(F.expr("l_orderkey % 5 = 1"), "B").otherwise(" ")
    number = F.when(F.expr("l_orderkey % 53 = 0"), "  xx").otherwise(
        F.lpad(F.expr("cast(l_orderkey % 97 as string)"), 4, " "))
    atom = pick(FRAME7, F.col("l_linenumber") - 1)
    # Each line is formatted once: filters on it stay above the generators. Two steps keep the generated
    # methods below the 8,000 bytes beyond which the JVM interprets a method instead of compiling it.
    parts = computed_once(rows, {
        "_head": F.concat(
            padded(record, -6), padded(F.expr("cast(line_no % 100000 as string)"), 5), F.lit("  "), padded(atom, -3), altloc,
            padded(pick(K.RESIDUES, F.expr("l_suppkey % 20")), 3), F.lit(" "),
            F.when(F.col("l_returnflag") == "R", " ").otherwise(F.coalesce(F.col("l_returnflag"), F.lit("null"))),
            padded(number, 4), F.when(F.col("l_linestatus") == "O", "A").otherwise(" "), F.lit("   ")),
        "_x": (F.col("l_quantity") - 25.5) * 0.37, "_y": whole("(l_partkey * 7) % 41 - 20") * 0.53,
        "_z": whole("line_no % 41 - 20") * 0.47,
        "_tail": F.concat(F.lit("  1.00  0.00          "), padded(
            F.when(F.expr("l_suppkey % 2 = 0"), F.substring(atom, 1, 1)).otherwise(" "), 2)),
    })
    line = F.concat("_head", *[coordinate(F.col(c)) for c in ("_x", "_y", "_z")], "_tail")
    name = F.concat(F.lit("P"), F.col("l_partkey")).alias("structure_id")
    lines = computed_once(parts, {"line": line}).select(name, "line_no", "line")
    ends = table(spark, d, "part").where("p_partkey % 3 = 0").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("structure_id"),
        F.lit(80004).cast("bigint").alias("line_no"), F.lit("ENDMDL").alias("line"),
    )
    return lines.unionByName(ends)


LINES = f"""
line_rows AS (
  SELECT l_partkey, l_orderkey * 8 + l_linenumber AS line_no, max(l_orderkey) AS l_orderkey,
         max(l_linenumber) AS l_linenumber, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity,
         max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus
  FROM lineitem GROUP BY 1, 2),
parsed AS (
  SELECT 'P' || l_partkey AS structure_id, line_no, {ATOM7}[l_linenumber] AS atom,
         {RES}[CAST(l_suppkey % 20 AS INTEGER) + 1] AS res_name,
         CASE WHEN l_returnflag = 'R' THEN '_' ELSE l_returnflag END AS chain_id,
         CAST(l_orderkey % 97 AS INTEGER) AS res_no,
         CASE WHEN l_linestatus = 'O' THEN 'A' ELSE '_' END AS icode,
         round((l_quantity - 25.5e0) * 0.37e0, 3) AS x,
         round(CAST((l_partkey * 7) % 41 - 20 AS DOUBLE) * 0.53e0, 3) AS y,
         round(CAST(line_no % 41 - 20 AS DOUBLE) * 0.47e0, 3) AS z,
         substring({ATOM7}[l_linenumber], 1, 1) AS element,
         l_linestatus = 'O' AND l_quantity > 40 AS hetatm,
         CASE l_orderkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS altloc
  FROM line_rows
  WHERE l_orderkey % 53 <> 0 AND (l_partkey % 3 <> 0 OR line_no < 80004))"""


# ---- documents as sequences ------------------------------------------------

def sequences(spark: SparkSession, d: str) -> DataFrame:
    """Letters of whole texts; the id orders like a path."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("structure_id"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("pdb_path"),
        F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"),
    )


SEQUENCES = """
seqs AS (
  SELECT 'D' || doc_id AS structure_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS pdb_path,
         upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence
  FROM documents)"""


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id", F.md5("text").alias("sequence_hash"), "lang", "source",
        F.when(F.expr("doc_id % 10 < 8"), "train").when(F.expr("doc_id % 10 = 8"), "val")
        .otherwise("test").alias("split"),
    )


SPLIT_ROWS = """
split_rows AS (
  SELECT doc_id, md5(text) AS sequence_hash, lang, source,
         CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split
  FROM documents)"""


# ---- scored examples and predictions --------------------------------------

def scored(spark: SparkSession, d: str) -> DataFrame:
    """Twenty logits per example, folded from all 64 embedding values."""
    e = table(spark, d, "embeddings")
    dims = [F.get("embedding", F.lit(i)).cast("double") for i in range(64)]
    logits = []
    for c in range(20):
        total = dims[c]
        for i in range(c + 20, 64, 20):
            total = total + dims[i]
        logits.append(total * 5.0)
    return e.select(
        F.col("vec_id").alias("example_id"), F.array(*logits).alias("logits"),
        F.expr("cast(label + 10 * (vec_id % 2) as int)").alias("label"),
    )


_LOGITS = ", ".join(
    "(" + " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(c, 64, 20)) + ") * 5.0e0"
    for c in range(20)
)
SCORED = f"""
logit AS (
  SELECT vec_id AS example_id, [{_LOGITS}] AS logits, CAST(label + 10 * (vec_id % 2) AS INTEGER) AS label
  FROM embeddings),
weights AS (
  SELECT *, list_transform(logits, lambda v: exp(v - list_max(logits))) AS w FROM logit),
scored AS (
  SELECT example_id, logits, label, list_transform(w, lambda v: v / list_sum(w)) AS probs,
         CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted
  FROM weights),
ranked AS (
  SELECT example_id, label, c - 1 AS cls, probs[c] AS p,
         row_number() OVER (PARTITION BY example_id ORDER BY logits[c] DESC, c) AS rnk
  FROM scored, unnest(range(1, 21)) AS u(c)),
scored_rows AS (
  SELECT s.*, list_max(probs) AS confidence,
         list_sum(list_transform(probs, lambda p: -p * ln(p + 1e-12))) AS entropy
  FROM scored s)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Report rows: a label, a sometimes wrong prediction and a confidence."""
    li = table(spark, d, "lineitem")
    actual = F.expr("l_partkey % 20")
    predicted = F.expr(
        "(l_partkey + CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber WHEN l_suppkey % 7 = 1 THEN 5 ELSE 0 END) % 20")
    named = li.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_no"),
        pick(K.TITLE_NAMES, actual).alias("actual"), pick(K.TITLE_NAMES, predicted).alias("predicted"),
        (F.col("l_quantity") / 50.0 - F.col("l_discount") / 10.0).alias("confidence"),
        (F.col("l_extendedprice") / 40000.0 + F.col("l_tax")).alias("entropy"),
    )
    from voxlake.functions.residues import property_type
    return named.withColumns({
        "actual_type": property_type(F.col("actual")), "predicted_type": property_type(F.col("predicted")),
        "correct": F.col("actual") == F.col("predicted"),
    })


TYPE_CASE = "CASE " + " ".join(
    f"WHEN {{0}} IN ({', '.join(repr(a) for a in names)}) THEN '{kind}'"
    for kind, names in K.PROPERTY_TYPES.items() if names
) + " ELSE 'Unknown' END"
PREDICTIONS = f"""
named AS (
  SELECT (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_no,
         {TITLES}[CAST(l_partkey % 20 AS INTEGER) + 1] AS actual,
         {TITLES}[CAST((l_partkey + CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber
                        WHEN l_suppkey % 7 = 1 THEN 5 ELSE 0 END) % 20 AS INTEGER) + 1] AS predicted,
         l_quantity / 50.0e0 - l_discount / 10.0e0 AS confidence,
         l_extendedprice / 40000.0e0 + l_tax AS entropy
  FROM lineitem),
preds AS (
  SELECT *, {TYPE_CASE.format('actual')} AS actual_type, {TYPE_CASE.format('predicted')} AS predicted_type,
         actual = predicted AS correct
  FROM named)"""


# ---- samples, classes ------------------------------------------------------

def samples(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as dense samples of 4 channels x 16 cells."""
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_path"), F.col("label"), F.col("embedding").alias("x"),
        F.array(*[F.lit(v) for v in (4, 4, 2, 2)]).alias("shape"),
        F.expr("cast(vec_id % 6 as int)").alias("part"),
    )


CELLS = """
cells AS (
  SELECT vec_id, CAST(vec_id % 6 AS INTEGER) AS part, CAST(i - 1 AS INTEGER) AS cell,
         CAST((i - 1) // 16 AS INTEGER) AS ch, CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, unnest(range(1, 65)) AS u(i))"""


def classes(spark: SparkSession, d: str) -> DataFrame:
    """Labelled shard examples; labels are far from equally frequent."""
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(
        F.expr("cast(pmod(l_partkey * l_partkey, 20) as int)").alias("label")
    ).withColumn("split", F.lit("train"))


CLASS_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CLASSES = """
classes AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST((l_partkey * l_partkey) % 20 AS INTEGER) AS label
  FROM lineitem)"""


def hash_sql(seed, key) -> str:
    return f"md5(concat_ws('_', '{seed}', {', '.join(key)}))"


def rank_sql(seed, key, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {hash_sql(seed, key)}, {', '.join(key)})"


def with_sql(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(c.strip() for c in ctes) + "\n"


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})
