"""The closed ontology of the property graph, and the explicit schemas of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Labels, art types, eras and books.
LABELS = ("人物", "门派", "武功", "地点")
PERSON, SECT, ART, PLACE = LABELS
ART_TYPES = ("内功", "外功", "轻功", "暗器")
BOOK_ERA = {"射雕英雄传": "射雕", "神雕侠侣": "神雕", "倚天屠龙记": "倚天"}
ERA_KEYWORDS = {
    "射雕": ("射雕",), "射雕英雄传": ("射雕",), "南宋": ("射雕", "神雕"), "神雕": ("神雕",), "神雕侠侣": ("神雕",),
    "倚天": ("倚天",), "倚天屠龙记": ("倚天",), "元末": ("倚天",), "明初": ("倚天",),
}

# Relation, labels it may start and end at, whether it is symmetric.
RELATIONS = (
    ("MASTER_OF", (PERSON,), (PERSON,), False),
    ("SPOUSE_OF", (PERSON,), (PERSON,), True),
    ("PARENT_OF", (PERSON,), (PERSON,), False),
    ("SWORN_BROTHER_OF", (PERSON,), (PERSON,), True),
    ("ENEMY_OF", (PERSON,), (PERSON,), True),
    ("BELONGS_TO", (PERSON,), (SECT,), False),
    ("MASTERS", (PERSON,), (ART,), False),
    ("FOUNDER_OF", (PERSON,), (SECT,), False),
    ("LOCATED_IN", (PERSON, SECT, PLACE), (PLACE,), False),
    ("BRANCHED_FROM", (SECT, ART), (SECT, ART), False),
    ("DESCENDANT_OF", (PERSON,), (PERSON,), False),
)

# Names that are no names.
NOISE_NAMES = (
    "师父", "大师父", "白雕", "汗血宝马", "小红马", "神雕", "大雕", "雕儿",
    "某", "某人", "那汉", "那女子", "之", "其", "此人", "那人",
)

CHUNK = "chunk_id string, logical_id string, book string, era string, chapter string, offset int, end int, content_hash string, text string"
NODE = "label string, name string, era string, first_seen_era string, eras array<string>, books array<string>, description string, location string, art_type string, aliases array<string>"
EDGE = "type string, src_label string, src string, dst_label string, dst string, chunk_ids array<string>, snippets array<string>, eras array<string>, books array<string>, confidence string"
ALIAS = "alias string, canonical string, label string, applicable_eras array<string>, source string, note string"
QUESTION = "id string, question string, category string, relation string, hop int, difficulty string, answer_entities array<string>, acceptable_answers array<string>, source_hint string"
PAYLOAD = (
    "entities array<struct<name:string,type:string,era:string,description:string,location:string,art_type:string>>,"
    "relationships array<struct<source:string,target:string,type:string,evidence:string>>"
)


def ontology(spark: SparkSession) -> DataFrame:
    """The relations as a table: type, domain, range, symmetric (11 rows)."""
    rows = [(t, list(d), list(r), s) for t, d, r, s in RELATIONS]
    return spark.createDataFrame(rows, "type string, domain array<string>, range array<string>, symmetric boolean")
