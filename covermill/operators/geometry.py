"""Atoms in periodic cells: neighbours, the pair filter, local environments and their features.

``frames`` have ``frame_id, lattice (9 numbers), pbc (3 flags), atoms (symbol, pos, forces)``. Frames without a valid
cell or without atoms have no atoms rows; repeated frames count once; symbols are taken in their usual case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermill.functions.scalar import angle_degrees, cell_ok, det3

# fixed values: covalent radii in angstrom by symbol, hydrogen to curium
RADII_TEXT = """
H 0.31 He 0.28 Li 1.28 Be 0.96 B 0.84 C 0.76 N 0.71 O 0.66 F 0.57 Ne 0.58 Na 1.66 Mg 1.41 Al 1.21 Si 1.11 P 1.07 S 1.05 Cl 1.02 Ar 1.06
K 2.03 Ca 1.76 Sc 1.70 Ti 1.60 V 1.53 Cr 1.39 Mn 1.39 Fe 1.32 Co 1.26 Ni 1.24 Cu 1.32 Zn 1.22 Ga 1.22 Ge 1.20 As 1.19 Se 1.20 Br 1.20 Kr 1.16
Rb 2.20 Sr 1.95 Y 1.90 Zr 1.75 Nb 1.64 Mo 1.54 Tc 1.47 Ru 1.46 Rh 1.42 Pd 1.39 Ag 1.45 Cd 1.44 In 1.42 Sn 1.39 Sb 1.39 Te 1.38 I 1.39 Xe 1.40
Cs 2.44 Ba 2.15 La 2.07 Ce 2.04 Pr 2.03 Nd 2.01 Pm 1.99 Sm 1.98 Eu 1.98 Gd 1.96 Tb 1.94 Dy 1.92 Ho 1.92 Er 1.89 Tm 1.90 Yb 1.87 Lu 1.87
Hf 1.75 Ta 1.70 W 1.62 Re 1.51 Os 1.44 Ir 1.41 Pt 1.36 Au 1.36 Hg 1.32 Tl 1.45 Pb 1.46 Bi 1.48 Po 1.40 At 1.50 Rn 1.50
Fr 2.60 Ra 2.21 Ac 2.15 Th 2.06 Pa 2.00 U 1.96 Np 1.90 Pu 1.87 Am 1.80 Cm 1.69
"""
RADII = dict(zip(RADII_TEXT.split()[::2], map(float, RADII_TEXT.split()[1::2])))
#: Radius of a symbol that is none of these.
OTHER_RADIUS = 0.2


def _one(frames: DataFrame) -> DataFrame:
    return frames.select("frame_id", "lattice", "pbc", "atoms").where("frame_id is not null").dropDuplicates(["frame_id"])


def atoms_of(frames: DataFrame) -> DataFrame:
    """``frame_id, i, symbol, x, y, z`` with ``i`` from 0, and ``lattice``."""
    return _exploded(_one(frames), ["lattice"])


def _exploded(one: DataFrame, keep: list[str]) -> DataFrame:
    rows = one.select("frame_id", *keep, F.posexplode("atoms").alias("i", "a"))
    at = [F.col("a.pos")[k].cast("double").alias(n) for k, n in enumerate("xyz")]
    return rows.select("frame_id", *keep, "i", F.initcap(F.trim("a.symbol")).alias("symbol"), *at).where("x is not null and y is not null and z is not null")


def _inverse(cell: Column) -> list[Column]:
    a = [cell[i] for i in range(9)]
    d = det3(cell)
    minors = [
        a[4] * a[8] - a[5] * a[7], a[2] * a[7] - a[1] * a[8], a[1] * a[5] - a[2] * a[4],
        a[5] * a[6] - a[3] * a[8], a[0] * a[8] - a[2] * a[6], a[2] * a[3] - a[0] * a[5],
        a[3] * a[7] - a[4] * a[6], a[1] * a[6] - a[0] * a[7], a[0] * a[4] - a[1] * a[3],
    ]
    return [m / d for m in minors]


def neighbours(frames: DataFrame, cutoff: float) -> DataFrame:
    """``frame_id, i, j, symbol_i, symbol_j, distance, dx, dy, dz`` for each ordered pair within ``cutoff``.

    Distances are to the nearest image, found among the 27 around the wrapped difference (exact for reduced cells);
    an axis without periodicity has no images. Atoms meet in bins along the cell's axes that are no thinner than the
    cutoff, so the pairs of a large frame grow with its atoms and not with their square.
    """
    one = frames.where("frame_id is not null").where(cell_ok(F.col("lattice"), 0.0)).select("frame_id", "lattice", "pbc", "atoms")
    # taken once per frame: below the aggregation that drops repeated frames, so it is not inlined into each pair
    one = one.withColumn("inv", F.array(*_inverse(F.col("lattice"))))
    # the height of the cell along axis k is one over the length of column k of the inverse
    high = [f"1 / sqrt(inv[{k}] * inv[{k}] + inv[{k + 3}] * inv[{k + 3}] + inv[{k + 6}] * inv[{k + 6}])" for k in range(3)]
    one = one.withColumn("high", F.expr(f"array({', '.join(high)})"))
    bins = [f"if(coalesce(pbc[{k}], true), greatest(1, cast(floor(high[{k}] / {cutoff}D) as int)), 1)" for k in range(3)]
    one = one.withColumn("bins", F.expr(f"array({', '.join(bins)})")).dropDuplicates(["frame_id"])
    rows = _exploded(one, ["lattice", "high", "pbc", "inv", "bins"])
    frac = [F.expr(f"x * inv[{k}] + y * inv[{3 + k}] + z * inv[{6 + k}]").alias(f"f{k}") for k in range(3)]
    rows = rows.select("frame_id", "lattice", "high", "pbc", "i", "symbol", *frac, *[F.col("bins")[k].alias(f"n{k}") for k in range(3)])
    rows = rows.select("*", *[F.least(F.floor((F.col(f"f{k}") - F.floor(f"f{k}")) * F.col(f"n{k}")).cast("int"), F.col(f"n{k}") - 1).alias(f"b{k}") for k in range(3)])
    beside = F.expr("flatten(flatten(transform(array_distinct(transform(sequence(-1, 1), s -> pmod(b0 + s, n0))), p -> transform(array_distinct(transform(sequence(-1, 1), s -> pmod(b1 + s, n1))), q -> transform(array_distinct(transform(sequence(-1, 1), s -> pmod(b2 + s, n2))), r -> struct(p, q, r))))))")
    sent = rows.select("frame_id", F.col("i").alias("j"), F.col("symbol").alias("symbol_j"), *[F.col(f"f{k}").alias(f"g{k}") for k in range(3)], F.explode(beside).alias("to"))
    sent = sent.select("frame_id", "j", "symbol_j", "g0", "g1", "g2", F.col("to.p").alias("b0"), F.col("to.q").alias("b1"), F.col("to.r").alias("b2"))
    met = rows.join(sent, ["frame_id", "b0", "b1", "b2"]).where("i <> j")
    on = [F.coalesce(F.col("pbc")[k], F.lit(True)) for k in range(3)]
    diff = [F.when(on[k], F.col(f"g{k}") - F.col(f"f{k}") - F.rint(F.col(f"g{k}") - F.col(f"f{k}"))).otherwise(F.col(f"g{k}") - F.col(f"f{k}")).alias(f"d{k}") for k in range(3)]
    pair = ["frame_id", "b0", "b1", "b2", "i", "j", F.col("symbol").alias("symbol_i"), "symbol_j"]
    steps = F.array(*[F.struct(*[F.lit(c).alias(f"c{k}") for k, c in enumerate((x, y, z))]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    near = met.select(*pair, "lattice", "high", "pbc", *diff)
    pair[6] = "symbol_i"
    # an image is no nearer than its step along any axis, so most pairs have one image to look at or none
    near = near.where(" and ".join(f"abs(d{k}) * high[{k}] <= {cutoff}D" for k in range(3)))
    further = F.expr(" or ".join(f"(1 - abs(d{k})) * high[{k}] <= {cutoff}D" for k in range(3)))
    near = near.withColumn("t", F.explode(F.when(further, steps).otherwise(F.array(F.struct(*[F.lit(0).alias(f"c{k}") for k in range(3)])))))
    for k in range(3):
        near = near.where(on[k] | (F.col(f"t.c{k}") == 0))
    moved = [" + ".join(f"(d{m} + t.c{m}) * lattice[{3 * m + k}]" for m in range(3)) + f" as d{n}" for k, n in enumerate("xyz")]
    near = near.selectExpr(*pair, *moved).withColumn("distance", F.expr("sqrt(dx * dx + dy * dy + dz * dz)")).where(F.col("distance") <= cutoff)
    # a pair's images are where its join key is, so this takes no shuffle
    nearest = near.groupBy(*pair).agg(F.min(F.struct("distance", "dx", "dy", "dz")).alias("v"))
    return nearest.select("frame_id", "i", "j", "symbol_i", "symbol_j", "v.*")


def _radius(symbol: Column) -> Column:
    pairs = [x for s, r in RADII.items() for x in (F.lit(s), F.lit(r))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), symbol), F.lit(OTHER_RADIUS))


def too_close(frames: DataFrame, coeff: float = 0.8) -> DataFrame:
    """``frame_id, n_close``: frames with pairs nearer than ``(r_i + r_j) * coeff``, strictly."""
    # the search goes as far as the largest atoms that there are; symbols are as few as elements
    symbols = [r[0] for r in frames.select(F.explode(F.array_distinct("atoms.symbol")).alias("s")).select(F.initcap(F.trim("s")).alias("s")).where(F.col("s").isin(list(RADII))).distinct().collect()]
    pairs = neighbours(frames, 2 * max([OTHER_RADIUS, *(RADII[s] for s in symbols)]) * coeff).where("i < j")
    close = pairs.where(F.col("distance") < (_radius(F.col("symbol_i")) + _radius(F.col("symbol_j"))) * coeff)
    return close.groupBy("frame_id").agg(F.count("*").alias("n_close"))


def physical(frames: DataFrame, coeff: float = 0.8) -> DataFrame:
    """``frame_id, is_physical, reason`` of every frame; a frame with one atom or none passes."""
    rows = frames.select("frame_id").where("frame_id is not null").distinct().join(too_close(frames, coeff), "frame_id", "left")
    return rows.select("frame_id", F.col("n_close").isNull().alias("is_physical"), F.when(F.col("n_close").isNotNull(), "pair_distance_below_limit").alias("reason"))


def environments(frames: DataFrame, rcut: float) -> DataFrame:
    """``neighbours`` of the frames whose cell is large enough for the cutoff; others are left out for this cutoff."""
    return neighbours(frames.where(cell_ok(F.col("lattice"), rcut)), rcut)


def meta_keys(near: DataFrame, rcut: float, centers: tuple[str, ...] = ("Fe", "C")) -> DataFrame:
    """``frame_id, i, meta, cn``: ``r<rcut>:<center>:cn<n>:<sorted neighbour symbols>``; centers alone have none."""
    near = near.where(F.col("symbol_i").isin(*centers))
    rows = near.groupBy("frame_id", "i", F.col("symbol_i").alias("center")).agg(F.count("*").alias("cn"), F.concat_ws("", F.array_sort(F.collect_list("symbol_j"))).alias("around"))
    return rows.select("frame_id", "i", F.format_string(f"r{rcut:.1f}:%s:cn%d:%s", "center", "cn", "around").alias("meta"), "cn")


def features(near: DataFrame) -> DataFrame:
    """``frame_id, i, feature``: sorted bond lengths, then mean and population deviation of the bond angles; one
    neighbour has (90, 0), two have a deviation of 0."""
    bonds = near.groupBy("frame_id", "i").agg(F.array_sort(F.collect_list("distance")).alias("bonds"), F.collect_list(F.struct("j", "distance", "dx", "dy", "dz")).alias("v"))
    cosine = "(p.dx * q.dx + p.dy * q.dy + p.dz * q.dz) / (greatest(p.distance, 1e-10D) * greatest(q.distance, 1e-10D))"
    angles = f"flatten(transform(v, p -> transform(filter(v, q -> p.j < q.j), q -> degrees(acos(greatest(-1D, least(1D, {cosine})))))))"
    rows = bonds.withColumn("angles", F.expr(angles))
    mean = F.expr("if(size(angles) = 0, 90D, aggregate(angles, 0D, (s, a) -> s + a) / size(angles))")
    rows = rows.withColumn("mean", mean)
    deviation = F.expr("if(size(angles) < 2, 0D, sqrt(aggregate(angles, 0D, (s, a) -> s + (a - mean) * (a - mean)) / size(angles)))")
    return rows.select("frame_id", "i", F.concat("bonds", F.array("mean", deviation)).alias("feature"))


def raw_tokens(near: DataFrame, rcut: float, centers: tuple[str, ...] = ("Fe", "C")) -> DataFrame:
    """``frame_id, i, raw, meta``: a canonical hash of the local graph, the same under rotation, shift and renumbering.

    Bonds are pairs within the cutoff. The hash is over the center's symbol and its neighbours' symbols, each with
    the number of its own bonds to other neighbours.
    """
    inner = near.select("frame_id", F.col("i").alias("j"), F.col("j").alias("k"))
    around = near.select("frame_id", "i", F.col("j").alias("k"))
    linked = near.select("frame_id", "i", "j").join(inner, ["frame_id", "j"]).join(around, ["frame_id", "i", "k"]).groupBy("frame_id", "i", "j").agg(F.count("*").alias("inner_bonds"))
    rows = near.where(F.col("symbol_i").isin(*centers)).select("frame_id", "i", "j", "symbol_i", "symbol_j").join(linked, ["frame_id", "i", "j"], "left").na.fill(0, ["inner_bonds"])
    text = F.concat_ws("|", F.array_sort(F.collect_list(F.concat("symbol_j", F.lit("~"), F.col("inner_bonds").cast("string"))))).alias("graph")
    rows = rows.groupBy("frame_id", "i", F.col("symbol_i").alias("center")).agg(text)
    raw = F.concat(F.lit(f"r{rcut:.1f}:"), F.substring(F.sha1(F.concat_ws(":", "center", "graph")), 1, 16))
    return rows.select("frame_id", "i", raw.alias("raw")).join(meta_keys(near, rcut, centers).select("frame_id", "i", "meta"), ["frame_id", "i"])


def token_dim(tokens: DataFrame, feats: DataFrame, samples: int = 5) -> DataFrame:
    """``raw, meta, feature``: of each raw token the meta of its last record and the mean feature of its first
    ``samples`` records, one per record; none where these differ in length."""
    one = tokens.join(feats, ["frame_id", "i"], "left").withColumn("turn", F.row_number().over(Window.partitionBy("raw", "frame_id").orderBy("i"))).where("turn = 1")
    meta = one.groupBy("raw").agg(F.max_by("meta", "frame_id").alias("meta"))
    kept = one.withColumn("nth", F.row_number().over(Window.partitionBy("raw").orderBy("frame_id"))).where(F.col("nth") <= samples)
    flat = kept.select("raw", F.size("feature").alias("n"), F.posexplode("feature").alias("pos", "value"))
    means = flat.groupBy("raw", "pos").agg(F.avg("value").cast("float").alias("value"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    shape = F.when(F.min("lo") == F.max("hi"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])).alias("feature")
    return meta.join(means.groupBy("raw").agg(shape), "raw", "left")


def examples(tokens: DataFrame, most: int = 3) -> DataFrame:
    """``raw, frame_id, i``: the first ``most`` centers of each raw token in each record."""
    w = Window.partitionBy("raw", "frame_id").orderBy("i")
    return tokens.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).select("raw", "frame_id", "i")


def local_cluster(frames: DataFrame, rcut: float, vacuum: float = 8.0, eps: float = 1e-6) -> DataFrame:
    """``frame_id, i, n_atoms, box``: the edge of the cube around a center's neighbours, with vacuum."""
    near = neighbours(frames, rcut + eps)
    span = [F.greatest(F.max(d), F.lit(0.0)) - F.least(F.min(d), F.lit(0.0)) for d in ("dx", "dy", "dz")]
    rows = near.groupBy("frame_id", "i").agg((F.count("*") + 1).alias("n_atoms"), F.greatest(*span).alias("span"))
    return rows.select("frame_id", "i", "n_atoms", F.greatest(F.col("span") + vacuum, F.lit(2 * rcut + vacuum), F.lit(vacuum)).alias("box"))


def cluster_atoms(frames: DataFrame, rcut: float, vacuum: float = 8.0) -> DataFrame:
    """``frame_id, i, j, symbol, x, y, z, box``: a center and its neighbours in the middle of their cube; the center is
    its own ``j``."""
    near = neighbours(frames, rcut + 1e-6)
    boxes = local_cluster(frames, rcut, vacuum)
    own = near.groupBy("frame_id", "i", F.col("symbol_i").alias("symbol")).agg(F.lit(0.0).alias("dx")).select("frame_id", "i", F.col("i").alias("j"), "symbol", *[F.lit(0.0).alias(d) for d in ("dx", "dy", "dz")])
    atoms = own.unionByName(near.select("frame_id", "i", "j", F.col("symbol_j").alias("symbol"), "dx", "dy", "dz"))
    ends = atoms.groupBy("frame_id", "i").agg(*[((F.min(d) + F.max(d)) / 2).alias(f"m{d}") for d in ("dx", "dy", "dz")])
    rows = atoms.join(ends, ["frame_id", "i"]).join(boxes.select("frame_id", "i", "box"), ["frame_id", "i"])
    return rows.select("frame_id", "i", "j", "symbol", *[(F.col(f"d{n}") - F.col(f"md{n}") + F.col("box") / 2).alias(n) for n in "xyz"], "box")


def bond_angles(near: DataFrame) -> DataFrame:
    """``frame_id, i, j, k, kind, angle`` of each pair of neighbours ``j < k``; ``kind`` is their symbols around the
    center's, the outer two sorted."""
    # one pass over the neighbours; a center's are few, as atoms keep apart
    v = F.collect_list(F.struct("j", "symbol_j", "distance", "dx", "dy", "dz")).alias("v")
    around = near.groupBy("frame_id", "i", "symbol_i").agg(v)
    first = around.select("frame_id", "i", "symbol_i", "v", F.explode("v").alias("p"))
    both = first.select("frame_id", "i", "symbol_i", "p", F.explode(F.expr("filter(v, q -> q.j > p.j)")).alias("q"))
    cosine = F.expr("(p.dx * q.dx + p.dy * q.dy + p.dz * q.dz) / (greatest(p.distance, 1e-10D) * greatest(q.distance, 1e-10D))")
    kind = F.concat_ws("-", F.least("p.symbol_j", "q.symbol_j"), "symbol_i", F.greatest("p.symbol_j", "q.symbol_j"))
    return both.select("frame_id", "i", F.col("p.j").alias("j"), F.col("q.j").alias("k"), kind.alias("kind"), angle_degrees(cosine).alias("angle"))
