"""Views that give the driver's tables the shapes of a long-text back end: novels, documents, chapters, usage, tasks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.functions.segment import Words
from fabula.operators import graph, tables, words
from fabula.operators.tables import numbered

#: A token: letters of any language; runs of ideographs are cut by DICTIONARY.
LETTERS = words.LETTERS

#: Words of the Chinese rows, with frequencies and flags, and those that the novels with even numbers have besides.
DICTIONARY = [
    ("沈砚", 90, "nr"), ("陆青", 80, "nr"), ("安静", 100, "nr"), ("苏晚", 60, "nr"), ("落霞镇", 40, "ns"), ("青石城", 40, "ns"), ("石城", 20, "ns"), ("天剑宗", 30, "nt"),
    ("请安静", 30, "v"), ("来了", 90, "v"), ("看见", 90, "v"), ("走进", 70, "v"), ("走", 70, "v"), ("吹过", 30, "v"), ("长风", 50, "n"), ("他", 300, "r"), ("说", 300, "v"), ("在", 300, "p"),
]
OWN_WORDS = [("顾长风", None, "nr")]
SCENE_NAMES, SCENE_PLACES = ("沈砚", "顾长风", "陆青", "安静", "苏晚"), ("落霞镇", "青石城", "石城")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def document(self) -> DataFrame:
        novel = F.substring("source", 4, 9).cast("long")
        return self.table("documents").select(
            "doc_id",
            novel.alias("novel_id"),
            (novel % 3).alias("owner_id"),
            "source",
            "lang",
            "text",
            F.col("n_chars").alias("word_count"),
            F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("done").alias("status"),
            (F.col("doc_id") % 29 == 0).alias("deleted"),
        )

    def prose(self) -> DataFrame:
        """The documents for work on their texts: on all cores, however the table was written."""
        return tables.spread(self.document(), "doc_id")

    def link(self) -> DataFrame:
        return self.document().where("doc_id % 5 <> 0").select("doc_id", F.col("novel_id").alias("kb_id"))

    def linked(self) -> DataFrame:
        """Documents of knowledge bases: kb_id is the novel's id; every fifth document is not linked yet."""
        return self.document().where("doc_id % 5 <> 0").withColumn("kb_id", F.col("novel_id"))

    def novel(self) -> DataFrame:
        return self.document().select("novel_id", "owner_id", "source").distinct()

    def chapter(self) -> DataFrame:
        """A novel's documents, numbered. Only ids are numbered, in spans; texts are joined to them."""
        d = self.document()
        texts = self.prose()
        no = numbered(d.select("novel_id", "doc_id"), ["novel_id"], "doc_id", "chapter_no").select("doc_id", "chapter_no")
        return no.join(texts, "doc_id").select("novel_id", "owner_id", "doc_id", "chapter_no", F.col("text").alias("content"), "word_count").withColumn("title", F.concat(F.lit("Chapter "), F.col("chapter_no").cast("string")))

    def usage(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            (F.col("user_id") % 3).alias("owner_id"),
            F.when(F.col("event_id") % 50 != 0, F.col("event_type")).alias("model"),
            (F.col("user_id") % 5).alias("config_id"),
            F.when(F.col("event_id") % 2 == 0, "chat").otherwise("embed").alias("task_type"),
            F.floor("value").cast("long").alias("tokens_in"),
            (F.col("event_id") % 97).alias("tokens_out"),
            ((F.floor("value").cast("long") * 3 + F.col("event_id") % 97 * 7).cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")).alias("cost"),
            F.col("ts").alias("created_at"),
        )

    def task_event(self) -> DataFrame:
        status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "signup", "cancelled").otherwise("running")
        task = F.col("event_id") % 500
        return self.table("events").select(task.alias("task_id"), F.col("event_id").alias("seq"), status.alias("status"), (F.col("user_id") % 3).alias("owner_id"), F.when(task % 9 != 0, task % 50).alias("novel_id"), (task % 4 == 0).alias("is_long"), F.col("ts"))

    @cached_property
    def dictionary(self) -> Words:
        return words.load(self.spark.createDataFrame(DICTIONARY, "word string, freq long, flag string"))

    def token(self) -> DataFrame:
        return words.tokens(self.prose(), ["novel_id", "doc_id"], "text", self.dictionary)

    def scene(self) -> DataFrame:
        """Chinese chapters of about a thousand characters, with a line for each of 64 events that follow one another."""
        pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
        who, whom = pick(SCENE_NAMES, F.col("user_id")), pick(SCENE_NAMES, F.col("event_id"))
        where = pick(SCENE_PLACES, F.col("event_id"))
        line = (
            F.when(F.col("event_type") == "view", F.concat(who, F.lit("说"), whom, F.lit("来了。")))
            .when(F.col("event_type") == "click", F.concat(F.lit("他在"), where, F.lit("看见"), who, F.lit("！")))
            .when(F.col("event_type") == "purchase", F.concat(who, F.lit("走进天剑宗，“请安静”。\n")))
            .when(F.col("event_type") == "signup", F.concat(F.lit("Anna met "), who, F.lit("?")))
            .otherwise(F.concat(F.lit("长风吹过"), where, F.lit("，")))
        )
        lines = self.table("events").select(F.floor(F.col("event_id") / 64).alias("doc_id"), F.struct("event_id", line.alias("line")).alias("l"))
        text = F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "")
        return lines.groupBy("doc_id").agg(text.alias("text")).select((F.col("doc_id") % 5).alias("novel_id"), "doc_id", "text")

    def scene_words(self) -> DataFrame:
        """(novel_id, word, freq, flag) what the novels of the scenes have in their own dictionaries."""
        own = self.spark.createDataFrame(OWN_WORDS, "word string, freq long, flag string")
        return own.withColumn("novel_id", F.explode(F.array(*[F.lit(n).cast("long") for n in (0, 2, 4)]))).select("novel_id", "word", "freq", "flag")

    def scene_token(self) -> DataFrame:
        """(novel_id, doc_id, pos, token, flag)"""
        cut = words.tokens(self.scene(), ["novel_id", "doc_id"], "text", self.dictionary, "novel_id", self.scene_words())
        general = self.spark.createDataFrame(DICTIONARY, "token string, freq long, general string").drop("freq")
        flagged = graph.tagged(cut, self.scene_words().drop("freq"), ["novel_id"], default="")
        return flagged.join(F.broadcast(general), "token", "left").withColumn("flag", F.coalesce(F.nullif("flag", F.lit("")), "general", F.lit("x"))).drop("general")

    @cached_property
    def _entities(self) -> DataFrame:
        return tables.known(self._entity(), graph.MOST_ENTITIES)[0]

    def entity(self) -> DataFrame:
        """The 100 most frequent tokens of four to six letters of each novel, with a type and an id; they are counted once for a query."""
        return self._entities

    def cast(self) -> DataFrame:
        """(novel_id, name) of the entities that are characters."""
        return self.entity().where("type = 'character'").select("novel_id", "name")

    def _entity(self) -> DataFrame:
        n = self.token().where("length(token) between 4 and 6").groupBy("novel_id", "token").agg(F.count("*").alias("freq"))
        place = F.row_number().over(Window.partitionBy("novel_id").orderBy(F.desc("freq"), "token"))
        types = F.element_at(F.array(*map(F.lit, ("character", "place", "org", "item"))), (F.col("place") % 4 + 1).cast("int"))
        return n.withColumn("place", place).where("place <= 100").select("novel_id", F.col("token").alias("name"), "freq", F.col("place").cast("long").alias("entity_no"), types.alias("type"))

    def edge(self) -> DataFrame:
        """Co-occurrences of each novel's entities, counted in the documents."""
        docs = words.token_lists(self.prose(), ["novel_id", "doc_id"], "text", self.dictionary)
        return graph.entity_pairs(docs, "novel_id", "doc_id", "tokens", self.entity())

    def relation(self) -> DataFrame:
        """The 60 heaviest co-occurrences of each novel's entities."""
        edges = self.edge()
        place = F.row_number().over(Window.partitionBy("novel_id").orderBy(F.desc("weight"), "source", "target"))
        return edges.withColumn("place", place).where("place <= 60").drop("place")

    def fragment(self) -> DataFrame:
        blank = F.col("doc_id") % 3 == 0
        return self.table("documents").select((F.col("doc_id") % 40).cast("string").alias("name"), F.col("doc_id").alias("seq"), F.when(blank, "").otherwise(F.col("lang")).alias("role"), F.when(blank, "").otherwise(F.col("text")).alias("description"))


def _scene_sql() -> str:
    """The words of each line of a scene, as whoever wrote the line means them."""
    lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    name = lambda by: f"(case when {lists(SCENE_NAMES)}[cast({by} % 5 as int) + 1] <> '顾长风' then [{lists(SCENE_NAMES)}[cast({by} % 5 as int) + 1]] when event_id // 64 % 5 % 2 = 0 then ['顾长风'] else ['顾', '长风'] end)"
    where = f"[{lists(SCENE_PLACES)}[cast(event_id % 3 as int) + 1]]"
    flags = " ".join(f"when '{w}' then '{f}'" for w, _, f in DICTIONARY + OWN_WORDS)
    return f"""scene_line as (select event_id, event_id // 64 doc_id, case event_type when 'view' then {name("user_id")} || ['说'] || {name("event_id")} || ['来了'] when 'click' then ['他', '在'] || {where} || ['看见'] || {name("user_id")}
 when 'purchase' then {name("user_id")} || ['走进', '天剑宗', '请安静'] when 'signup' then ['anna', 'met'] || {name("user_id")} else ['长风', '吹过'] || {where} end ws from events),
scene_token as (select doc_id % 5 novel_id, doc_id, row_number() over (partition by doc_id order by event_id, i) - 1 pos, token, case token {flags} else 'x' end flag from (select event_id, doc_id, unnest(range(0, len(ws))) i, unnest(ws) token from scene_line))"""


#: The same views in SQL, for the oracle.
SQL = """with document as (select doc_id, cast(substr(source, 4) as bigint) novel_id, cast(substr(source, 4) as bigint) % 3 owner_id, source, lang, text, n_chars word_count,
 case when doc_id % 11 = 0 then 'failed' else 'done' end status, doc_id % 29 = 0 deleted from documents),
linked as (select *, novel_id kb_id from document where doc_id % 5 <> 0),
chapter as (select novel_id, owner_id, doc_id, row_number() over (partition by novel_id order by doc_id) chapter_no, text content, word_count, 'Chapter ' || row_number() over (partition by novel_id order by doc_id) title from document),
usage as (select event_id, user_id % 3 owner_id, case when event_id % 50 <> 0 then event_type end model, user_id % 5 config_id, case when event_id % 2 = 0 then 'chat' else 'embed' end task_type,
 cast(floor(value) as bigint) tokens_in, event_id % 97 tokens_out, cast(cast(floor(value) as bigint) * 3 + event_id % 97 * 7 as decimal(18,0)) * cast(0.000001 as decimal(7,6)) cost, ts created_at from events),
task_event as (select event_id % 500 task_id, event_id seq, case event_type when 'error' then 'failed' when 'purchase' then 'success' when 'signup' then 'cancelled' else 'running' end status, user_id % 3 owner_id,
 case when (event_id % 500) % 9 <> 0 then (event_id % 500) % 50 end novel_id, (event_id % 500) % 4 = 0 is_long, ts from events),
novel as (select distinct novel_id, owner_id, source from document),
words as (select novel_id, doc_id, regexp_extract_all(lower(text), '\\p{L}+') ws from document),
token as (select novel_id, doc_id, unnest(range(0, len(ws))) pos, unnest(ws) token from words),
entity as (select novel_id, token as name, freq, place entity_no, ['character', 'place', 'org', 'item'][cast(place % 4 + 1 as int)] type from
 (select *, row_number() over (partition by novel_id order by freq desc, token) place from (select novel_id, token, count(*) freq from token where length(token) between 4 and 6 group by all)) where place <= 100),
mention as (select t.*, row_number() over (partition by t.novel_id, t.doc_id order by t.pos) nth from token t join entity e on t.novel_id = e.novel_id and t.token = e.name),
edge as (select a.novel_id, least(a.token, b.token) source, greatest(a.token, b.token) target, count(*) weight from mention a join mention b on a.novel_id = b.novel_id and a.doc_id = b.doc_id and b.nth between a.nth - 80 and a.nth - 1 and a.token <> b.token group by all),
relation as (select novel_id, source, target, weight from (select *, row_number() over (partition by novel_id order by weight desc, source, target) place from edge) where place <= 60),
fragment as (select cast(doc_id % 40 as varchar) as name, doc_id seq, case when doc_id % 3 = 0 then '' else lang end role_, case when doc_id % 3 = 0 then '' else text end description from documents)
"""
#: The Chinese rows, for the queries that read them.
SCENE_SQL = "with " + _scene_sql() + " "
