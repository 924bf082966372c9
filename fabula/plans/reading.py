"""Registered queries on texts that are written without spaces: words, names, co-occurrences and contexts in Chinese rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula.fixtures import SCENE_SQL
from fabula.operators import graph, rules, words
from fabula.plans.queries import query


@query("""select doc_id, pos, token, flag from scene_token""", SCENE_SQL)
def scene_words(v):
    """Words and flags; a novel's own words are cut out in that novel only."""
    return v.scene_token().select("doc_id", F.col("pos").cast("long").alias("pos"), "token", "flag")


@query("""select novel_id, token as name, count(*) freq, min(doc_id) first_doc from scene_token where flag = 'nr' group by all having count(*) >= 2""", SCENE_SQL)
def scene_people(v):
    """Candidates for characters: words that the dictionaries flag as names."""
    named = v.scene_token().where((F.col("flag") == "nr") & rules.valid_name(F.col("token")))
    return named.groupBy("novel_id", F.col("token").alias("name")).agg(F.count("*").alias("freq"), F.min("doc_id").alias("first_doc")).where("freq >= 2")


@query(""", m as (select *, row_number() over (partition by doc_id order by pos) nth from scene_token where flag in ('nr', 'ns', 'nt'))
 select a.novel_id, least(a.token, b.token) source, greatest(a.token, b.token) target, count(*) weight from m a join m b on a.doc_id = b.doc_id and b.nth between a.nth - 80 and a.nth - 1 and a.token <> b.token group by all""", SCENE_SQL)
def scene_cooccurrence(v):
    mentions = v.scene_token().where(F.col("flag").isin("nr", "ns", "nt"))
    return graph.cooccurrence(mentions, ["novel_id"], "doc_id", "pos", "token")


@query()
def scene_contexts(v):
    """What a chapter says around each name that stands in it as a word; held against a plain version in the tests."""
    people = v.scene_token().where("flag = 'nr'").select("novel_id", F.col("token").alias("name")).distinct()
    return words.contexts(v.scene(), ["novel_id", "doc_id"], "text", people, "novel_id", v.dictionary)


@query("""select doc_id, token, flag = 'nr' and length(token) between 2 and 6 and token not in ('他', '说', '在') and not regexp_full_match(token, '[0-9]+') named from scene_token""", SCENE_SQL)
def scene_names(v):
    """Which words count as names: flagged so, of two to six characters, no stop words, not digits alone."""
    return v.scene_token().select("doc_id", "token", ((F.col("flag") == "nr") & rules.valid_name(F.col("token"))).alias("named"))


_NAMES = """(select event_id, case event_id % 6 when 0 then '的' when 1 then cast(user_id as varchar) when 2 then 'the name ' || user_id when 3 then '林' || user_id when 4 then '' else event_type end as name from events)"""


@query(f"""select event_id, name, length(name) between 2 and 6 and name not in ('的') and not regexp_full_match(name, '[0-9]+') valid from {_NAMES}""", "")
def name_validity(v):
    """Names that the rule passes and names that each part of it rejects: stop words, digits alone, too short and too long ones."""
    k, uid = F.col("event_id") % 6, F.col("user_id").cast("string")
    name = F.when(k == 0, "的").when(k == 1, uid).when(k == 2, F.concat(F.lit("the name "), uid)).when(k == 3, F.concat(F.lit("林"), uid)).when(k == 4, "").otherwise(F.col("event_type"))
    return v.table("events").select("event_id", name.alias("name"), rules.valid_name(name).alias("valid"))


@query("""select novel_id, token as name, freq, first_doc, cast(row_number() over (partition by novel_id order by freq desc, first_doc, token) as bigint) as rank from (select novel_id, token, count(*) freq, min(doc_id) first_doc from scene_token where flag = 'nr' group by all)""", SCENE_SQL)
def scene_ranking(v):
    """Candidates for characters in the order in which they are offered."""
    named = v.scene_token().where("flag = 'nr'").groupBy("novel_id", F.col("token").alias("name")).agg(F.count("*").alias("freq"), F.min("doc_id").alias("first"))
    return graph.ranked(named, "novel_id").withColumnRenamed("first", "first_doc")


@query("""select 'entity' kind, novel_id, name as source, '' target from entity where entity_no % 7 <> 0 union all select 'relation', r.novel_id, source, target from relation r where not exists (select 1 from entity e where e.novel_id = r.novel_id and e.name in (r.source, r.target) and e.entity_no % 7 = 0)""")
def entity_delete(v):
    """Entities after every seventh has gone, and the relations that are left with both ends."""
    e, r = graph.delete_entities(v.entity(), v.relation(), v.entity().where("entity_no % 7 = 0"), "novel_id")
    e = e.select(F.lit("entity").alias("kind"), "novel_id", F.col("name").alias("source"), F.lit("").alias("target"))
    return e.unionByName(r.select(F.lit("relation").alias("kind"), "novel_id", "source", "target"))
