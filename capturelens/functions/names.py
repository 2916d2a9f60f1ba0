"""Sequence ids, frame names and frame-list labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR_BASE = 2147483647  # fixed value: pair key = smaller id * PAIR_BASE + larger id


def composite_id(dataset: Column, sequence: Column) -> Column:
    return F.concat_ws("_", dataset, sequence)


def derived_from(seq_id: Column, part_prefix: str = "btg_") -> Column:
    """Id of the sequence a derived one was made from, empty when it is an original."""
    return (
        F.when(seq_id.endswith("_rgb"), F.regexp_replace(seq_id, "_rgb$", ""))
        .when(
            seq_id.startswith(part_prefix) & seq_id.contains("_p"),
            F.regexp_replace(seq_id, "^(.*)_p.*$", "$1"),
        )
        .otherwise("")
    )


# Id prefix -> scene the sequences of that prefix look at.
SCENE_OF_PREFIX = {
    "mots_": "mots_plot",
    "blt_gr_": "blt_gerovassiliou",
    "blt_uk_": "blt_riseholme",
    "emb_": "emb",
    "slam_": "slam",
}


def scene_group(seq_id: Column) -> Column:
    """Group of sequences that are not independent samples of a scene."""
    part = F.concat(F.lit("btg_"), F.element_at(F.split(F.substr(seq_id, F.lit(5)), "_p"), 1))
    flight = F.when(seq_id.contains("V2"), "bot_V2").otherwise("bot_V1")
    rules = F.when(seq_id.startswith("btg_"), part).when(seq_id.startswith("bot_"), flight)
    for prefix, scene in SCENE_OF_PREFIX.items():
        rules = rules.when(seq_id.startswith(prefix), scene)
    return rules.otherwise(seq_id)


def frame_index(name: Column) -> Column:
    """Trailing digits before the extension."""
    return F.regexp_extract(name, r"(\d+)\.\w+$", 1).try_cast("bigint")


def label_global(label: Column) -> Column:
    return F.regexp_extract(label, r"global (\d+)", 1).try_cast("bigint")


def label_bag_time(label: Column) -> Column:
    return F.regexp_extract(label, r"bag_time=([\d.]+)s", 1).try_cast("double")


def label_header_stamp(label: Column) -> Column:
    return F.regexp_extract(label, r"header_stamp=([\d.]+)", 1).try_cast("double")


def frame_stem(name: Column) -> Column:
    """Name without its image extensions, however often they are repeated."""
    return F.regexp_replace(name, r"(?i)(\.(png|jpe?g))+$", "")


def mask_candidates(name: Column) -> Column:
    """File names a mask of this frame may have, best first: its own, then those of each stem.

    Image extensions go one at a time, so ``a.png.jpg`` is looked for under ``a.png`` before ``a``; another extension stays.
    """
    endings = F.regexp_extract(name, r"(?i)((\.(png|jpe?g))+)$", 1)
    dropped = F.sequence(F.lit(1), F.size(F.split(endings, r"\.")) - 1)
    last = lambda k: F.array_join(F.slice(F.split(name, r"\."), F.lit(1), F.size(F.split(name, r"\.")) - k), ".")
    tails = F.array(*[F.lit(t) for t in (".png", ".jpg.png", ".png.png")])
    tried = F.flatten(F.transform(dropped, lambda k: F.transform(tails, lambda t: F.concat(last(k), t))))
    return F.array_distinct(F.concat(F.array(name), F.when(endings != "", tried).otherwise(F.array().cast("array<string>"))))


def pair_key(a: Column, b: Column) -> Column:
    """The unordered pair as a struct."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def pair_number(a: Column, b: Column) -> Column:
    """The unordered pair as one number."""
    return F.least(a, b).cast("bigint") * F.lit(PAIR_BASE).cast("bigint") + F.greatest(a, b)


def altitude_note(notes: Column) -> Column:
    """Median, minimum and maximum altitude out of free-text notes (the last note that has them)."""
    number = r"([\d.]+) m"
    pattern = f"GPS altitude median {number}, min {number}, max {number}"
    hit = F.try_element_at(F.filter(notes, lambda n: n.rlike(pattern)), F.lit(-1))
    pick = lambda i: F.regexp_extract(F.coalesce(hit, F.lit("")), pattern, i)
    return F.struct(
        pick(1).alias("alt_median"), pick(2).alias("alt_min"), pick(3).alias("alt_max")
    )
