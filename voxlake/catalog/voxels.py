"""Checks of structures, residues and voxel examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.catalog import views as V
from voxlake.functions.residues import bond_dim, residue_dim
from voxlake.operators import legacy as old
from voxlake.operators.residues import (
    RESIDUE_KEY, assemble_sequences, atom_positions, dedupe_by_sequence, first_row_per_id, residues_from_atoms,
)
from voxlake.operators.surface import sphere_points
from voxlake.operators.voxels import (
    VoxelConfig, box_join, dense_samples, mean_over_sites, pack_examples, sample_totals, screen_centres, smooth_sparse, voxel_counts,
)
from voxlake.plans import voxels as P
from voxlake.sources.structures import ca_trace, first_files, first_model_lines, parse_atoms, parse_legacy_atoms

QUERIES, SQL = {}, {}
RELAXED = VoxelConfig(template="backbone")
DENSE = VoxelConfig(template="backbone", density=0.025)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def centres(spark, d, config=RELAXED):
    return screen_centres(residues_from_atoms(V.atoms(spark, d)), config).where("skip is null")


def counted(spark, d, config=RELAXED):
    return voxel_counts(box_join(centres(spark, d, config), V.atoms(spark, d), config))


ATOM_COLUMNS = "structure_id, line_no, atom, res_name, chain_id, res_no, icode, x, y, z, element, hetatm, altloc"


@query("atom_records", V.with_sql(V.LINES) + f"SELECT {ATOM_COLUMNS} FROM parsed WHERE altloc <> 'B' AND NOT hetatm")
def atom_records(spark, d):
    atoms = parse_atoms(first_model_lines(V.structure_text(spark, d)))
    return atoms.select(*ATOM_COLUMNS.split(", "))


@query("atom_records_with_hetero", V.with_sql(V.LINES) + "SELECT structure_id, hetatm, altloc, count(*) AS n FROM parsed WHERE altloc <> 'B' GROUP BY ALL")
def atom_records_with_hetero(spark, d):
    atoms = parse_atoms(first_model_lines(V.structure_text(spark, d)), include_hetero=True)
    return atoms.groupBy("structure_id", "hetatm", "altloc").agg(F.count("*").alias("n"))


@query("legacy_atom_records", V.with_sql(V.LINES) + "SELECT structure_id, line_no, atom, res_name, replace(chain_id, '_', ' ') AS chain_id, res_no, element FROM parsed WHERE NOT hetatm")
def legacy_atom_records(spark, d):
    atoms = parse_legacy_atoms(first_model_lines(V.structure_text(spark, d)))
    return atoms.select("structure_id", "line_no", "atom", "res_name", "chain_id", "res_no", "element")


def trace_sql(keys: str, order: str) -> str:
    letter = f"substr('{K.ONE_LETTER}', list_position({V.RES}, res_name), 1)"
    return f""",
trace AS (
  SELECT {keys}, arg_min(res_name, line_no) AS res_name FROM parsed
  WHERE atom = 'CA' AND NOT hetatm GROUP BY {keys}),
structures AS (
  SELECT structure_id, string_agg({letter}, '' ORDER BY {order}) AS sequence,
         array_to_string(list_sort(list(DISTINCT chain_id)), ';') AS chains,
         len(list(DISTINCT chain_id)) AS num_chains, count(*) AS num_residues
  FROM trace GROUP BY structure_id)"""


def structure_rows(spark, d, icode=True):
    trace = ca_trace(first_model_lines(V.structure_text(spark, d)), icode)
    return assemble_sequences(trace, ["chain_id", "res_no"] + (["icode"] if icode else []))


def manifest_columns(df):
    return df.select(
        "structure_id", "sequence", F.concat_ws(";", "chains").alias("chains"),
        F.size("chains").alias("num_chains"), "num_residues")


ICODE = trace_sql("structure_id, chain_id, res_no, icode", "chain_id, res_no, icode")
PLAIN = trace_sql("structure_id, chain_id, res_no", "chain_id, res_no")


@query("structure_manifest", V.with_sql(V.LINES) + ICODE + "SELECT * FROM structures WHERE num_residues >= 3")
def structure_manifest(spark, d):
    return manifest_columns(structure_rows(spark, d)).where("num_residues >= 3")


@query("split_sequences", V.with_sql(V.LINES) + PLAIN + "SELECT structure_id, sequence, num_residues FROM structures")
def split_sequences(spark, d):
    return structure_rows(spark, d, icode=False).select("structure_id", "sequence", "num_residues")


def with_paths(df):
    """Two files for each structure id, told apart by the line number."""
    return df.withColumn("pdb_path", F.concat("structure_id", F.lit("/"), F.expr("line_no % 2"), F.lit(".pdb")))


@query("structures_by_path", V.with_sql(V.LINES) + f""",
files AS (SELECT *, structure_id || '/' || (line_no % 2) || '.pdb' AS pdb_path FROM parsed),
trace AS (
  SELECT structure_id, pdb_path, chain_id, res_no, icode, arg_min(res_name, line_no) AS res_name FROM files
  WHERE atom = 'CA' AND NOT hetatm GROUP BY 1, 2, 3, 4, 5)
SELECT structure_id, pdb_path, string_agg(substr('{K.ONE_LETTER}', list_position({V.RES}, res_name), 1), '' ORDER BY chain_id, res_no, icode) AS sequence,
       count(*) AS num_residues
FROM trace GROUP BY 1, 2""")
def structures_by_path(spark, d):
    trace = ca_trace(with_paths(first_model_lines(V.structure_text(spark, d))))
    return assemble_sequences(trace, ["chain_id", "res_no", "icode"]).select("structure_id", "pdb_path", "sequence", "num_residues")


@query("first_structure_files", V.with_sql(V.LINES) + "SELECT structure_id, min(structure_id || '/' || (line_no % 2) || '.pdb') AS pdb_path FROM line_rows JOIN (SELECT DISTINCT 'P' || l_partkey AS structure_id, l_partkey AS k FROM lineitem) ON l_partkey = k GROUP BY 1")
def first_structure_files(spark, d):
    files = with_paths(V.structure_text(spark, d)).select("structure_id", "pdb_path").distinct()
    return first_files(files)


@query("deduped_structures", V.with_sql(V.SEQUENCES) + "SELECT min(pdb_path) AS pdb_path, md5(sequence) AS seq FROM seqs GROUP BY sequence")
def deduped_structures(spark, d):
    return dedupe_by_sequence(V.sequences(spark, d)).select("pdb_path", F.md5("sequence").alias("seq"))


@query("first_structure_rows", "SELECT l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1")
def first_structure_rows(spark, d):
    li = V.table(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"))
    return first_row_per_id(li, "l_suppkey", "pos").select("l_suppkey", "l_orderkey")


@query("residue_table", V.with_sql(V.ATOM_ROWS) + """,
last AS (SELECT *, row_number() OVER (PARTITION BY structure_id, chain_id, res_no, res_name, atom
           ORDER BY l_orderkey DESC, l_partkey DESC, l_quantity DESC) AS rn FROM atom_rows)
SELECT structure_id, chain_id, res_no, res_name, array_to_string(list_sort(list(atom)), ',') AS atom_names,
       max(x) FILTER (atom = 'CA') AS ca_x, max(y) FILTER (atom = 'CA') AS ca_y, max(z) FILTER (atom = 'CB') AS cb_z
FROM last WHERE rn = 1 GROUP BY 1, 2, 3, 4""")
def residue_table(spark, d):
    r = residues_from_atoms(V.atom_rows(spark, d))
    return r.select(
        *RESIDUE_KEY, F.concat_ws(",", "atom_names").alias("atom_names"),
        F.col("ca.x").alias("ca_x"), F.col("ca.y").alias("ca_y"), F.col("cb.z").alias("cb_z"))


@query("residue_positions", V.with_sql(V.ATOMS) + "SELECT structure_id, chain_id, res_no, res_name, count(*) AS atoms, max(x) FILTER (atom = 'O') AS o_x FROM atoms GROUP BY 1, 2, 3, 4")
def residue_positions(spark, d):
    r = atom_positions(V.atoms(spark, d))
    return r.select(*RESIDUE_KEY, F.size("atoms").cast("bigint").alias("atoms"),
                    F.try_element_at("atoms", F.lit("O"))["x"].alias("o_x"))


@query("local_frames", V.with_sql(V.FRAMES) + "SELECT structure_id, chain_id, res_no, res_name, " + ", ".join(f"round({a}{k}, 6) + 0.0e0 AS {a}{k}" for a in "uvw" for k in "xyz") + " FROM frames")
def local_frames(spark, d):
    axes = [f"{a}{k}" for a in "uvw" for k in "xyz"]
    return centres(spark, d).select(*RESIDUE_KEY, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in axes])


@query("site_voxels", V.with_sql(V.BOXED) + "SELECT * FROM voxels")
def site_voxels(spark, d):
    return counted(spark, d)


@query("site_voxels_backbone4", V.with_sql(V.FRAMES, ) + V.boxed(channel="['N','CA','C','O']", token="a.atom") + "SELECT * FROM voxels")
def site_voxels_backbone4(spark, d):
    return counted(spark, d, VoxelConfig(template="backbone", channel_scheme="backbone4"))


@query("channel_counts", V.with_sql(V.BOXED) + "SELECT structure_id, chain_id, res_no, res_name, ch, count(*) AS occupied, CAST(sum(v) AS BIGINT) AS atoms FROM voxels GROUP BY ALL")
def channel_counts(spark, d):
    return counted(spark, d).groupBy(*RESIDUE_KEY, "ch").agg(
        F.count("*").alias("occupied"), F.sum("v").cast("bigint").alias("atoms"))


@query("dense_examples", V.with_sql(V.BOXED) + "SELECT structure_id, chain_id, res_no, res_name, count(*) AS occupied, CAST(sum(v) AS BIGINT) AS atoms FROM voxels GROUP BY 1, 2, 3, 4 HAVING sum(v) > 200")
def dense_examples(spark, d):
    packed = pack_examples(counted(spark, d), DENSE)
    return packed.select(*RESIDUE_KEY, F.size("cells").cast("bigint").alias("occupied"),
                         F.col("atom_count").cast("bigint").alias("atoms"))


SKIPS = V.with_sql(V.BOXED) + """,
usable AS (SELECT structure_id, chain_id, res_no, res_name FROM frames),
kept AS (SELECT structure_id, chain_id, res_no, res_name FROM voxels GROUP BY 1, 2, 3, 4 HAVING sum(v) > 200),
reasons AS (
  SELECT CASE WHEN nx IS NULL OR rx IS NULL OR cx IS NULL THEN 'missing_atoms' ELSE 'degenerate' END AS skip
  FROM res r WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.structure_id = r.structure_id
    AND u.chain_id = r.chain_id AND u.res_no = r.res_no AND u.res_name = r.res_name)
  UNION ALL
  SELECT 'density' FROM (SELECT * FROM usable EXCEPT SELECT * FROM kept))
SELECT skip, count(*) AS n FROM reasons GROUP BY 1"""


@query("skip_counters", SKIPS)
def skip_counters(spark, d):
    return P.build_sites(V.atoms(spark, d), DENSE).skipped


@query("exact_template", V.with_sql(V.ATOMS) + ",\ntemplates AS (SELECT unnest(" + V.RES + ") AS res_name, unnest([" + ", ".join(V.sql_list(K.TEMPLATE_OF[r]) for r in K.RESIDUES) + "]) AS want) SELECT a.structure_id, a.chain_id, a.res_no, a.res_name, list_sort(list(DISTINCT atom)) = any_value(want) AS complete FROM atoms a JOIN templates t USING (res_name) GROUP BY 1, 2, 3, 4")
def exact_template(spark, d):
    s = screen_centres(residues_from_atoms(V.atoms(spark, d)), VoxelConfig())
    return s.select(*RESIDUE_KEY, (F.coalesce("skip", F.lit("")) != "missing_atoms").alias("complete"))


TARGETS = V.with_sql(V.FRAMES) + """,
targets AS (SELECT 'S' || s_suppkey AS structure_id, [s_suppkey % 50, s_nationkey + 20] AS positions
            FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT structure_id || '_' || chain_id || '_' || res_no || '_' || res_name AS example_id
FROM res JOIN targets USING (structure_id) WHERE list_contains(positions, res_no)"""


@query("mutated_site_centres", TARGETS)
def mutated_site_centres(spark, d):
    s = V.table(spark, d, "supplier").where("s_suppkey % 4 <> 0")
    targets = s.select(
        F.concat(F.lit("S"), "s_suppkey").alias("structure_id"),
        F.expr("concat(s_suppkey % 50, '; ', s_nationkey + 20)").alias("positions"))
    picked = P.pick_centres(residues_from_atoms(V.atoms(spark, d)), targets, None, 0)
    return picked.select(F.concat_ws("_", *RESIDUE_KEY).alias("example_id"))


@query("capped_sites", V.with_sql(V.FRAMES) + f", r AS (SELECT structure_id, chain_id, res_no, res_name, {V.rank_sql(3, RESIDUE_KEY, 'structure_id')} AS rnk FROM res) SELECT structure_id, chain_id, res_no, res_name FROM r WHERE rnk <= 5")
def capped_sites(spark, d):
    return P.pick_centres(residues_from_atoms(V.atoms(spark, d)), None, 5, 3).select(*RESIDUE_KEY)


SITES = V.with_sql(V.BOXED) + f"""
SELECT DISTINCT structure_id || '_' || chain_id || '_' || res_no || '_' || res_name AS example_id, structure_id,
       chain_id, CAST(res_no AS VARCHAR) AS res_no, res_name, CAST(list_position({V.RES}, res_name) - 1 AS VARCHAR) AS label,
       '/voxels/' || structure_id || '/' || structure_id || '_' || chain_id || '_' || res_no || '_' || res_name || '.npz' AS sample_path,
       'residue_identity' AS task, 'element4' AS channel_scheme
FROM voxels ORDER BY example_id"""


@query("site_manifest", SITES)
def site_manifest(spark, d):
    built = P.build_sites(V.atoms(spark, d), RELAXED)
    return P.site_manifest(built.packed, "/voxels", RELAXED).orderBy("example_id")


TAPS = """,
taps AS (SELECT k, exp(-0.5e0 * (k / 0.6e0) * (k / 0.6e0)) AS w FROM unnest(range(-2, 3)) AS u(k)),
norm AS (SELECT k, w / (SELECT sum(w) FROM taps) AS w FROM taps),
moved AS (
  SELECT structure_id, chain_id, res_no, res_name, ch, ix + a.k AS jx, iy + b.k AS jy, iz + c.k AS jz,
         v * a.w * b.w * c.w * 1000 AS v
  FROM voxels, norm a, norm b, norm c),
smooth AS (
  SELECT structure_id, chain_id, res_no, res_name, ch,
         CASE WHEN jx < 0 THEN -1 - jx WHEN jx > 19 THEN 39 - jx ELSE jx END AS ix,
         CASE WHEN jy < 0 THEN -1 - jy WHEN jy > 19 THEN 39 - jy ELSE jy END AS iy,
         CASE WHEN jz < 0 THEN -1 - jz WHEN jz > 19 THEN 39 - jz ELSE jz END AS iz, sum(v) AS v
  FROM moved GROUP BY ALL)
"""


@query("smoothed_voxels", V.with_sql(V.BOXED) + TAPS + "SELECT structure_id, chain_id, res_no, res_name, ch, count(*) AS cells, round(sum(v), 3) AS total, round(max(v), 4) AS peak FROM smooth GROUP BY ALL")
def smoothed_voxels(spark, d):
    s = smooth_sparse(counted(spark, d), RELAXED, rows=False)
    totals = sample_totals(s.select(*RESIDUE_KEY, "ch", F.size("x").cast("bigint").alias("cells"), "x"))
    return totals.withColumns({"total": F.round("total", 3), "peak": F.round("peak", 4)})


@query("smoothed_samples", V.with_sql(V.BOXED) + TAPS + "SELECT structure_id, chain_id, res_no, res_name, round(sum(v), 0) AS total, round(max(v), 0) AS peak FROM smooth GROUP BY 1, 2, 3, 4")
def smoothed_samples(spark, d):
    x = dense_samples(pack_examples(counted(spark, d), RELAXED), RELAXED)
    return V.rounded(sample_totals(x.select(*RESIDUE_KEY, "x")), 0, "total", "peak")


@query("structure_mean_voxels", V.with_sql(V.BOXED) + """,
sites AS (SELECT structure_id, count(*) AS n FROM (SELECT DISTINCT structure_id, chain_id, res_no, res_name FROM voxels) GROUP BY 1)
SELECT v.structure_id, ch, ix, iy, iz, round(sum(v) / any_value(n), 6) AS v
FROM voxels v JOIN sites s ON s.structure_id = v.structure_id GROUP BY 1, 2, 3, 4, 5""")
def structure_mean_voxels(spark, d):
    mean = mean_over_sites(counted(spark, d), ["structure_id"], ["chain_id", "res_no", "res_name"])
    return V.rounded(mean, 6, "v")


BIAS = tuple(K.LEGACY_BIAS)
LEGACY = VoxelConfig(template="backbone", exclude="sidechain", bias=BIAS)


@query("legacy_box_voxels", V.with_sql(V.FRAMES) + V.boxed(
    own="a.chain_id = f.chain_id AND a.res_no = f.res_no AND a.atom NOT IN ('N','CA','C','O')", bias=BIAS)
    + "SELECT * FROM voxels")
def legacy_box_voxels(spark, d):
    return counted(spark, d, LEGACY)


GRID = V.with_sql(V.ATOMS) + """,
extent AS (SELECT structure_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1
           FROM atoms GROUP BY 1),
grid AS (
  SELECT structure_id, CAST(gi AS INTEGER) AS gi, CAST(gj AS INTEGER) AS gj, CAST(gk AS INTEGER) AS gk,
         x0 + gi * 10.0e0 AS gx, y0 + gj * 10.0e0 AS gy, z0 + gk * 10.0e0 AS gz
  FROM extent, LATERAL (SELECT unnest(range(CAST(ceil((x1 - x0) / 10) AS BIGINT))) AS gi) a,
       LATERAL (SELECT unnest(range(CAST(ceil((y1 - y0) / 10) AS BIGINT))) AS gj) b,
       LATERAL (SELECT unnest(range(CAST(ceil((z1 - z0) / 10) AS BIGINT))) AS gk) c)
"""


@query("grid_points", GRID + "SELECT structure_id, gi, gj, gk, round(gx, 6) AS gx, round(gy, 6) AS gy, round(gz, 6) AS gz FROM grid")
def grid_points(spark, d):
    return V.rounded(old.grid_points(V.atoms(spark, d)), 6, "gx", "gy", "gz")


NEAREST = GRID + """,
dist AS (
  SELECT g.structure_id, gi, gj, gk, a.chain_id, a.res_no, a.res_name, a.atom, a.line_no,
         (a.x - gx) * (a.x - gx) + (a.y - gy) * (a.y - gy) + (a.z - gz) * (a.z - gz) AS d2
  FROM grid g JOIN atoms a ON a.structure_id = g.structure_id),
nearest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, gi, gj, gk ORDER BY d2, line_no) AS rn FROM dist)
  WHERE rn = 1)
"""


@query("nearest_grid_atoms", NEAREST + "SELECT structure_id, gi, gj, gk, chain_id, res_no, atom, round(d2, 6) AS d2 FROM nearest")
def nearest_grid_atoms(spark, d):
    a = V.atoms(spark, d)
    n = old.nearest_atoms(old.grid_points(a), a, start=2.5)
    return V.rounded(n.select("structure_id", "gi", "gj", "gk", "chain_id", "res_no", "atom", "d2"), 6, "d2")


@query("grid_picked_centres", NEAREST + ", picked AS (SELECT DISTINCT structure_id, chain_id, res_no FROM nearest) SELECT p.structure_id, p.chain_id, p.res_no, max(x) AS ca_x FROM picked p JOIN atoms a USING (structure_id, chain_id, res_no) WHERE a.atom = 'CA' GROUP BY 1, 2, 3")
def grid_picked_centres(spark, d):
    a = V.atoms(spark, d)
    picked = old.picked_centres(old.nearest_atoms(old.grid_points(a), a), residues_from_atoms(a).drop("atom_names"))
    return picked.select("structure_id", "chain_id", "res_no", F.col("ca.x").alias("ca_x"))


@query("label_blocks", V.with_sql(V.CLASSES) + f", r AS (SELECT label, {V.rank_sql(0, V.CLASS_KEY, 'label')} AS rnk FROM classes) SELECT label, (rnk - 1) // 100 AS block, count(*) AS n FROM r GROUP BY 1, 2")
def label_blocks(spark, d):
    b = old.label_blocks(V.classes(spark, d), V.CLASS_KEY, 100)
    return b.groupBy("label", "block").agg(F.count("*").alias("n"))


_SPHERE = ", ".join(f"({x!r}e0, {y!r}e0, {z!r}e0)" if "e" not in f"{x!r}{y!r}{z!r}" else f"({x!r}, {y!r}, {z!r})" for x, y, z in sphere_points(92))
_RAD = "CASE {0}.element WHEN 'C' THEN 1.7e0 WHEN 'N' THEN 1.55e0 WHEN 'O' THEN 1.52e0 WHEN 'S' THEN 1.8e0 ELSE 1.7e0 END + 1.4e0"
SURFACE = V.with_sql(V.ATOMS) + f""",
sized AS (SELECT a.*, {_RAD.format('a')} AS rad FROM atoms a),
sphere AS (SELECT row_number() OVER () AS pt, * FROM (VALUES {_SPHERE}) AS s(sx, sy, sz)),
pairs AS (
  SELECT i.structure_id, i.line_no, i.rad, j.rad AS qrad, i.x - j.x AS dx, i.y - j.y AS dy, i.z - j.z AS dz
  FROM sized i JOIN sized j ON j.structure_id = i.structure_id AND j.line_no <> i.line_no
  WHERE (i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y) + (i.z - j.z) * (i.z - j.z) < (i.rad + j.rad) * (i.rad + j.rad)),
buried AS (
  SELECT DISTINCT structure_id, line_no, pt FROM pairs, sphere
  WHERE (sx * rad + dx) * (sx * rad + dx) + (sy * rad + dy) * (sy * rad + dy) + (sz * rad + dz) * (sz * rad + dz) < qrad * qrad),
hidden AS (SELECT structure_id, line_no, count(*) AS n FROM buried GROUP BY 1, 2)
SELECT s.structure_id, s.chain_id, s.res_no, s.res_name, CAST(sum(92 - coalesce(n, 0)) AS BIGINT) AS exposed
FROM sized s LEFT JOIN hidden h ON h.structure_id = s.structure_id AND h.line_no = s.line_no GROUP BY 1, 2, 3, 4"""


@query("exposed_surface", SURFACE)
def exposed_surface(spark, d):
    from voxlake.operators.surface import exposed_points
    e = exposed_points(V.atoms(spark, d), ["structure_id", "line_no"])
    return e.groupBy(*RESIDUE_KEY).agg(F.sum("exposed").alias("exposed"))


# Largest possible residue areas (published theoretical set, 2013).
LARGEST = """('ALA', 129), ('ARG', 274), ('ASN', 195), ('ASP', 193), ('CYS', 167), ('GLN', 225), ('GLU', 223), ('GLY', 104), ('HIS', 224), ('ILE', 197), ('LEU', 201), ('LYS', 236), ('MET', 224), ('PHE', 240), ('PRO', 159), ('SER', 155), ('THR', 172), ('TRP', 285), ('TYR', 263), ('VAL', 174)"""
_PARTS = {"total": "true", "sidechain": "NOT main", "mainchain": "main", "polar": "polar", "apolar": "NOT polar"}
AREAS = SURFACE[:SURFACE.rindex("\nSELECT s.structure_id")] + f""",
area AS (SELECT s.structure_id, s.chain_id, s.res_no, s.res_name, atom IN ('N', 'CA', 'C', 'O') AS main, element IN ('N', 'O') AS polar,
                4 * pi() * rad * rad * (92 - coalesce(n, 0)) / 92e0 AS a
         FROM sized s LEFT JOIN hidden h ON h.structure_id = s.structure_id AND h.line_no = s.line_no),
sums AS (SELECT structure_id, chain_id, res_no, res_name, {', '.join(f'coalesce(sum(a) FILTER ({c}), 0) AS {n}' for n, c in _PARTS.items())} FROM area GROUP BY 1, 2, 3, 4)
SELECT structure_id, chain_id, res_no, res_name, {', '.join(f'round({n}, 3) AS abs_{n}, round({n} / largest, 5) AS rel_{n}' for n in _PARTS)}
FROM sums LEFT JOIN (VALUES {LARGEST}) AS m(name, largest) ON name = res_name"""


@query("residue_areas", AREAS)
def residue_area_rows(spark, d):
    t = P.sasa_table(V.atoms(spark, d))
    measures = {f"{kind}_{n}": digits for kind, digits in (("abs", 3), ("rel", 5)) for n in _PARTS}
    return t.select(*RESIDUE_KEY, *[F.round(n, digits).alias(n) for n, digits in measures.items()])


ODD = V.with_sql(V.ATOMS) + """,
odd AS (SELECT structure_id, chain_id || CASE WHEN res_no % 2 = 0 THEN 'x' ELSE 'y' END AS chain_id, res_no,
               CASE WHEN res_no % 5 = 0 THEN 'UNK' ELSE res_name END AS res_name, list(DISTINCT atom) AS names FROM atoms GROUP BY ALL)
SELECT chain_id, CASE WHEN res_name = 'UNK' THEN 'invalid_label' WHEN NOT list_has_all(names, ['N', 'CA', 'C']) THEN 'missing_atoms' ELSE 'usable' END AS outcome,
       count(*) AS n FROM odd GROUP BY 1, 2"""


@query("odd_residues", ODD)
def odd_residues(spark, d):
    """Residues with unknown names and chains of several characters."""
    atoms = V.atoms(spark, d).withColumns({
        "chain_id": F.concat("chain_id", F.when(F.col("res_no") % 2 == 0, "x").otherwise("y")),
        "res_name": F.when(F.col("res_no") % 5 == 0, "UNK").otherwise(F.col("res_name"))})
    s = screen_centres(residues_from_atoms(atoms), VoxelConfig(template="backbone"))
    return s.groupBy("chain_id", F.coalesce("skip", F.lit("usable")).alias("outcome")).agg(F.count("*").alias("n"))


# Label, names, group, type and number of template atoms, written out apart from the constants.
VOCABULARY = """
(0, 'HIS', 'H', 'group1', 'Positively Charged', 10), (1, 'LYS', 'K', 'group1', 'Positively Charged', 9), (2, 'ARG', 'R', 'group1', 'Positively Charged', 11),
(3, 'ASP', 'D', 'group2', 'Negatively Charged', 8), (4, 'GLU', 'E', 'group2', 'Negatively Charged', 9),
(5, 'SER', 'S', 'group3', 'Polar Uncharged', 6), (6, 'THR', 'T', 'group3', 'Polar Uncharged', 7), (7, 'ASN', 'N', 'group3', 'Polar Uncharged', 8), (8, 'GLN', 'Q', 'group3', 'Polar Uncharged', 9),
(9, 'ALA', 'A', 'group4', 'Hydrophobic', 5), (10, 'VAL', 'V', 'group4', 'Hydrophobic', 7), (11, 'LEU', 'L', 'group4', 'Hydrophobic', 8), (12, 'ILE', 'I', 'group4', 'Hydrophobic', 8), (13, 'MET', 'M', 'group4', 'Hydrophobic', 8),
(14, 'PHE', 'F', 'group5', 'Hydrophobic', 11), (15, 'TYR', 'Y', 'group5', 'Hydrophobic', 12), (16, 'TRP', 'W', 'group5', 'Hydrophobic', 14),
(17, 'PRO', 'P', 'group6', 'Special Case', 7), (18, 'GLY', 'G', 'group6', 'Special Case', 4), (19, 'CYS', 'C', 'group7', 'Special Case', 6)"""


@query("residue_vocabulary", f"SELECT s_suppkey, res3, res1, grp, aa_type, CAST(atoms AS INTEGER) AS atoms FROM supplier JOIN (VALUES {VOCABULARY}) AS v(label, res3, res1, grp, aa_type, atoms) ON label = s_suppkey % 20")
def residue_vocabulary(spark, d):
    s = V.table(spark, d, "supplier").withColumn("label", F.expr("cast(s_suppkey % 20 as int)"))
    dim = F.broadcast(residue_dim(spark))  # 20 rows
    return s.join(dim, "label").select("s_suppkey", "res3", "res1", "grp", "aa_type", F.size("atoms").alias("atoms"))


# Bonds and summed energy of each residue, written out apart from the table.
BOND_TOTALS = """('HIS', 10, 4235), ('LYS', 8, 3090), ('ARG', 10, 3968), ('ASP', 7, 3194), ('GLU', 8, 3541), ('SER', 5, 2102), ('THR', 6, 2449), ('ASN', 7, 3141), ('GLN', 8, 3488), ('ALA', 4, 1744), ('VAL', 6, 2438), ('LEU', 7, 2785), ('ILE', 7, 2785), ('MET', 7, 2609), ('PHE', 11, 4974), ('TYR', 12, 5332), ('TRP', 15, 6503), ('PRO', 7, 2743), ('GLY', 3, 1397), ('CYS', 5, 2003)"""


@query("bond_energies", f"SELECT s_suppkey, CAST(n AS BIGINT) AS bonds, CAST(total AS BIGINT) AS energy FROM supplier JOIN (VALUES {BOND_TOTALS}) AS b(res3, n, total) ON res3 = {V.RES}[CAST(s_suppkey % 20 AS INTEGER) + 1]")
def bond_energies(spark, d):
    s = V.table(spark, d, "supplier").withColumn("res3", V.pick(K.RESIDUES, F.expr("s_suppkey % 20")))
    dim = F.broadcast(bond_dim(spark))  # fixed table, under 200 rows
    return s.join(dim, "res3").groupBy("s_suppkey").agg(F.count("*").alias("bonds"), F.sum("energy").alias("energy"))
