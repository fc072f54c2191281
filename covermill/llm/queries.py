"""The queries of the problems, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermill.llm import encode, groups, history, leaks, neardup, pairs, reading, records, subset, terms
from covermill.session import Scratch, read_table

OVERLAP = records.Threshold(17, 20)
SAME = records.Threshold(4, 5)
LINK_SCORE = 0.85
COMMON_SHARE = 0.20
SUBSET_SIZE = 200


def _rare_most(spark: SparkSession, sf_dir: str) -> int:
    """``rare_freq_threshold`` of the earlier runs; the same in all."""
    value = read_table(spark, sf_dir, "initial_training_summary").agg(F.max("rare_freq_threshold")).first()[0]
    return 5 if value is None else int(value)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    envs = read_table(spark, sf_dir, "struct_envs")
    return terms.marked_terms(envs, "struct_id", "env", "center_atom_index", _rare_most(spark, sf_dir), COMMON_SHARE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("freq_mark is not null").select(F.col("value").alias("env"), "freq_mark")


def p1_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _marked(spark, sf_dir)
    return named.select(F.col("value").alias("env"), F.col("occurrences").alias("n_centers"), F.col("records").alias("n_structures"), "freq_mark")


def _env_classes(spark: SparkSession, sf_dir: str, scratch: Scratch, counted: bool = False) -> records.Classes:
    envs = read_table(spark, sf_dir, "struct_envs")
    unit = "center_atom_index" if counted else None
    return records.classes(scratch, records.record_sets(envs, "struct_id", "env", unit))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    found = pairs.similar_pairs(scratch, _env_classes(spark, sf_dir, scratch), OVERLAP)
    return found.select(F.col("a").alias("struct_a"), F.col("b").alias("struct_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per structure with its class of equal env sets and the class's links to other classes."""
    scratch = Scratch(spark)
    found = _env_classes(spark, sf_dir, scratch)
    links = pairs.class_pairs(scratch, found.sets, OVERLAP).select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    rows = found.members.join(links, "rep", "left").na.fill(0, ["n_links"])
    return rows.select(F.col("id").alias("struct_id"), F.col("rep").alias("class_id"), "n_links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "match_pairs")
    found = groups.match_groups(Scratch(spark), rows, "left_id", "right_id", "jaccard", LINK_SCORE)
    return found.select(F.col("id").alias("struct_id"), "group_id")


def p4_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    sets = records.record_sets(read_table(spark, sf_dir, "struct_envs"), "struct_id", "env")
    systems = read_table(spark, sf_dir, "structures").groupBy(F.col("struct_id").alias("id")).agg(F.max("system_name").alias("system"))
    rows = sets.select("id", "tokens").join(systems, "id", "left")
    chosen = subset.varied_subset(scratch, rows, SUBSET_SIZE)
    return chosen.select(F.col("id").alias("struct_id"), F.col("system").alias("system_name"), F.size("tokens").cast("long").alias("n_envs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    batches = read_table(spark, sf_dir, "structures").where("batch_no is not null").groupBy(F.col("struct_id").alias("id")).agg(F.min("batch_no").alias("batch"))
    sets = records.record_sets(read_table(spark, sf_dir, "struct_envs"), "struct_id", "env").join(batches, "id")
    index = history.SegmentIndex(spark, f"{scratch.root}/index", OVERLAP)
    found = history.replay(scratch, records.classes(scratch, sets, ("batch",)), index)
    return found.select(F.col("id").alias("struct_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    found = neardup.similar_groups(scratch, _env_classes(spark, sf_dir, scratch, counted=True), SAME)
    return found.select(F.col("id").alias("struct_id"), "group_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encoded(Scratch(spark), read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_joined_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids again, with every text of more than a thousand characters cut and its parts joined in a tree."""
    return encode.encoded(Scratch(spark), read_table(spark, sf_dir, "documents"), "doc_id", "text", part_chars=1000)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(Scratch(spark), read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("kind = 'passage'").select("doc_id", "item_id")


def p8_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "level_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _levels(spark, sf_dir).groupBy("reading_level")
    return by.agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.avg("margin").alias("mean_margin"))


def p9_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.held_out_levels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "level_labels"))


def queries() -> dict:
    every = (p1_found, p1_frequencies, p2_found, p2_classes, p3_found, p4_subset, p5_found, p6_found, p7_ids, p7_joined_ids, p8_found, p8_templates, p9_found, p9_profile, p9_held_out)
    return {f.__name__: f for f in every}


_ENVS = r"""e as (select distinct struct_id, center_atom_index, lower(regexp_replace(env, '[\s\p{Z}\p{Cf}]+', '', 'g')) env
 from struct_envs where struct_id is not null and lower(regexp_replace(env, '[\s\p{Z}\p{Cf}]+', '', 'g')) <> '')"""
_SETS = _ENVS + ", s as (select distinct struct_id, env from e), z as (select struct_id, count(*) n from s group by 1)"
_COUNTS = """f as (select env, count(*) n_centers, count(distinct struct_id) n_structures from e group by 1),
m as (select *, case when n_structures <= 5 then 'rare' when n_structures > 0.20 * (select count(distinct struct_id) from e) then 'common' end freq_mark from f)"""
_SIMILAR = """o as (select a.struct_id a, b.struct_id b, count(*) k from s a join s b on a.env = b.env and a.struct_id < b.struct_id group by 1, 2),
p as (select o.a, o.b from o join z x on x.struct_id = o.a join z y on y.struct_id = o.b where 20 * k >= 17 * (x.n + y.n - k))"""


# batch after batch, whatever their number; one row without structure goes along in each
_REPEATS = f"""with recursive {_SETS}, {_SIMILAR}, b as (select struct_id, min(batch_no) batch from structures where batch_no is not null group by 1),
 l as (select a x, b y from p union all select b, a from p), k as (select l.y, l.x, b.batch from l join b bx on bx.struct_id = l.x join b on b.struct_id = l.y where bx.batch < b.batch),
 n as (select batch, row_number() over (order by batch) turn from (select distinct batch from b)),
 h(turn, y) as (select 0, null::bigint union all
  select * from (select g.turn + 1, g.y from h g where g.turn < (select max(turn) from n)
   union all select distinct n.turn, k.y from k join n using (batch) where n.turn = (select max(turn) from h) + 1 and k.x not in (select y from h where y is not null)))
select distinct y as struct_id from h where y is not null"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_ENVS}, {_COUNTS} select env, freq_mark from m where freq_mark is not null",
        "p1_frequencies": f"with {_ENVS}, {_COUNTS} select env, n_centers, n_structures, freq_mark from m",
        "p2_found": f"with {_SETS}, {_SIMILAR} select a as struct_a, b as struct_b from p",
        "p2_classes": f"""with {_SETS}, v as (select struct_id, list(env order by env) l from s group by 1), c as (select struct_id, min(struct_id) over (partition by l) class_id from v), {_SIMILAR},
            k as (select a id from p where a in (select class_id from c) and b in (select class_id from c) union all select b from p where a in (select class_id from c) and b in (select class_id from c)), g as (select id, count(*) n from k group by 1)
            select struct_id, class_id, coalesce(n, 0) as n_links from c left join g on g.id = c.class_id""",
        "p3_found": """with recursive i as (select left_id id from match_pairs where left_id is not null union select right_id from match_pairs where right_id is not null),
            l as (select left_id a, right_id b from match_pairs where left_id is not null and right_id is not null and not isnan(jaccard) and jaccard >= 0.85),
            b as (select a, b from l union select b, a from l),
            c(id, root) as (select id, id from i union select b.b, c.root from c join b on b.a = c.id)
            select id as struct_id, min(root) as group_id from c group by 1""",
        "p5_found": _REPEATS,
        "p6_found": f"""with recursive {_ENVS}, s as (select struct_id, env, count(*) c from e group by 1, 2), z as (select struct_id, sum(c) n from s group by 1),
            o as (select a.struct_id a, b.struct_id b, sum(least(a.c, b.c)) k from s a join s b on a.env = b.env and a.struct_id < b.struct_id group by 1, 2),
            p as (select o.a, o.b from o join z x on x.struct_id = o.a join z y on y.struct_id = o.b where 5 * k >= 4 * (x.n + y.n - k)),
            l as (select a, b from p union all select b, a from p),
            g(id, root) as (select a, a from l union select l.b, g.root from g join l on l.a = g.id)
            select id as struct_id, min(root) as group_id from g group by 1""",
    }
