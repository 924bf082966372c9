"""Registered queries of what is asked and written around novels: similar chunks, pages, names, prompts, dramas, skills, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabula import storage
from fabula.functions import json as J
from fabula.functions import text as T
from fabula.operators import dashboard, graph, knn, model_calls, rules, sinks, tables, words, writing
from fabula.plans import kept, reading, search, stores  # noqa: F401  they register their queries
from fabula.plans.queries import _TASKS, ORACLES, QUERIES, TRIMMED, _chunk_sql, _chunks, _knn_sql, query

__all__ = ["ORACLES", "QUERIES"]


@query("""select doc_id, n.source from chapter c join novel n on c.novel_id = n.novel_id where n.owner_id = 1""")
def chapter_owned(v):
    """Chapters of novels that are the owner's."""
    return v.chapter().select("doc_id", "novel_id").join(v.novel().where("owner_id = 1").select("novel_id", "source"), "novel_id").select("doc_id", "source")


@query(f"""select k.rank as rank, k.vec_id chunk_id, coalesce(b.name, '') kb_name, substr(d.text, 1, 40) head from ({_knn_sql("q.vec_id = 7 and v.label <> 3", 10)}) k join embeddings e on e.vec_id = k.vec_id join documents d on d.doc_id = k.vec_id left join (select distinct label kb_id, 'base ' || label as name from embeddings where label % 3 <> 0) b on b.kb_id = e.label""")
def similar_chunks(v):
    """The ten chunks most like one, with their text and the name of their base, in the order of distance; disabled ones (here base 3) take no part."""
    e = v.table("embeddings")
    hits = knn.nearest(e.where("label <> 3"), e.where("vec_id = 7"), 10).select("rank", F.col("vec_id").alias("chunk_id"))
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("kb_id")).join(v.document().select(F.col("doc_id").alias("chunk_id"), F.substring("text", 1, 40).alias("head")), "chunk_id")
    bases = e.where("label % 3 <> 0").select(F.col("label").alias("kb_id")).distinct().withColumn("name", F.concat(F.lit("base "), F.col("kb_id").cast("string")))
    return hits.join(chunks, "chunk_id").join(bases, "kb_id", "left").select("rank", "chunk_id", F.coalesce("name", F.lit("")).alias("kb_name"), "head")


@query("""select doc_id, cast(seq as int) seq, total, cast(ceil(total / 20.0) as bigint) pages from (select doc_id, row_number() over (order by doc_id) seq, count(*) over () total from document where owner_id = 1 and not deleted) where seq > 20 and seq <= 40""")
def document_page(v):
    """The second page of an owner's documents, with the number of all."""
    own = tables.filtered(v.document(), owner_id=1, novel_id=None, deleted=False)
    return tables.page_with_total(own.select("doc_id"), 2, 20, F.col("doc_id")).select("doc_id", "seq", "total", "pages")


@query("""select doc_id, novel_id from document where owner_id = 1 and status in ('done') and lang in ('en', 'de')""")
def document_filter(v):
    """Only the filters that are supplied count."""
    return tables.filtered(v.document(), owner_id=1, status="done", lang=["en", "de"], doc_id=None).select("doc_id", "novel_id")


@query("""select doc_id, source from document where doc_id = 14 and owner_id = (select owner_id from document where doc_id = 14) and not deleted""")
def document_lookup(v):
    """One document by its id, for its owner."""
    owner = v.document().where("doc_id = 14").select("owner_id")
    return tables.lookup(v.document().join(owner, "owner_id", "left_semi"), F.col("owner_id"), doc_id=14).select("doc_id", "source")


_FLAGS = {"character": "nr", "place": "ns", "org": "nt", "item": "nz"}
_FLAG_SQL = "case e.type " + " ".join(f"when '{k}' then '{f}'" for k, f in _FLAGS.items()) + " else 'x' end"


def _tagged(v):
    flags = F.create_map(*[F.lit(x) for kv in _FLAGS.items() for x in kv])
    words = v.entity().select("novel_id", F.col("name").alias("word"), flags[F.col("type")].alias("flag"))
    return graph.tagged(v.token(), words, ["novel_id"])


@query(f"""select t.doc_id, {_FLAG_SQL} flag, count(*) n from token t left join entity e on t.novel_id = e.novel_id and t.token = e.name group by all""")
def segment_flags(v):
    """Tokens by the flag that the novel's own dictionary gives them."""
    return _tagged(v).groupBy("doc_id", "flag").agg(F.count("*").alias("n"))


@query("""select t.novel_id, e.type kind, t.token as name, count(*) freq, min(t.doc_id) first_doc from token t join entity e on t.novel_id = e.novel_id and t.token = e.name where e.type in ('place', 'org') group by all having count(*) >= 2""")
def place_org_freq(v):
    named = _tagged(v).where(F.col("flag").isin("ns", "nt") & rules.valid_name(F.col("token")))
    return named.groupBy("novel_id", F.when(F.col("flag") == "ns", "place").otherwise("org").alias("kind"), F.col("token").alias("name")).agg(F.count("*").alias("freq"), F.min("doc_id").alias("first_doc")).where("freq >= 2")


_TIMES = "'公元前' || user_id || '年' || (event_id % 12 + 1) || '月事。上古时期，' || (event_id % 21 + 1) || '世纪，永乐年间'"


@query(f"""select expression, count(*) freq from (select unnest(regexp_extract_all({_TIMES}, '{T.TIME}')) expression from events) group by 1""")
def time_freq(v):
    text = F.concat(F.lit("公元前"), F.col("user_id").cast("string"), F.lit("年"), (F.col("event_id") % 12 + 1).cast("string"), F.lit("月事。上古时期，"), (F.col("event_id") % 21 + 1).cast("string"), F.lit("世纪，永乐年间"))
    return v.table("events").select(F.explode(T.time_expressions(text)).alias("expression")).groupBy("expression").agg(F.count("*").alias("freq"))


_MARKED = "case when event_id % 4 = 0 then '无题 ' || user_id else '前言第' || (event_id % 30) || '章 甲' || user_id || '第2回乙' end"


@query(f"""select event_id, unnest(range(0, greatest(1, len(m)))) place, unnest(case when len(m) > 0 then m else [''] end) title, unnest(case when len(m) > 0 then p[2:] else [t] end) as content from (select event_id, t, regexp_extract_all(t, '{T.CHAPTER_MARK}') m, string_split_regex(t, '{T.CHAPTER_MARK}') p from (select event_id, {_MARKED} t from events))""")
def chapter_marks(v):
    """Chapters as the analysis of names cuts them: at every mark, wherever it stands."""
    number = lambda c: F.col(c).cast("string")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("无题 "), number("user_id"))).otherwise(F.concat(F.lit("前言第"), (F.col("event_id") % 30).cast("string"), F.lit("章 甲"), number("user_id"), F.lit("第2回乙")))
    cut = v.table("events").select("event_id", F.posexplode(T.mark_chapters(text)).alias("place", "c"))
    return cut.select("event_id", F.col("place").cast("long").alias("place"), "c.title", "c.content")


@query("""select c.novel_id, sha256('小说：' || n.source || chr(10) || '共' || c.total || '章' || chr(10) || c.preview) prompt_sha from (select novel_id, max(total) total, string_agg('---第' || chapter_no || '条(chapter_no=' || chapter_no || ')《' || title || '》前300字---' || chr(10) || substr(content, 1, 300), chr(10) || chr(10) order by chapter_no) preview from (select *, count(*) over (partition by novel_id) total from chapter) where chapter_no <= 3 group by 1) c join novel n using (novel_id)""")
def structure_prompt(v):
    """A prompt with the number of chapters and the first 300 characters of the first three."""
    c = v.chapter()
    no = F.col("chapter_no").cast("string")
    piece = F.concat(F.lit("---第"), no, F.lit("条(chapter_no="), no, F.lit(")《"), F.col("title"), F.lit("》前300字---\n"), F.substring("content", 1, 300))
    first = c.where("chapter_no <= 3").groupBy("novel_id").agg(F.sort_array(F.collect_list(F.struct("chapter_no", piece.alias("piece")))).alias("ps"))
    total = c.groupBy("novel_id").agg(F.count("*").alias("total"))
    prompt = writing.filled("小说：{novel}\n共{total}章\n{preview}", novel=F.col("source"), total=F.col("total"), preview=F.array_join(F.transform("ps", lambda p: p["piece"]), "\n\n"))
    return first.join(total, "novel_id").join(v.novel(), "novel_id").select("novel_id", F.sha2(prompt, 256).alias("prompt_sha"))


_HITS = "(select c.doc_id, e.name, e.entity_no from chapter c join entity e on c.novel_id = e.novel_id and e.type = 'character' and contains(lower(c.content), e.name))"


def _dramas(v):
    """A drama for each single chapter, and the characters that it names."""
    dramas = v.chapter().select(F.col("doc_id").alias("drama_id"), "novel_id", "chapter_no", "content")
    numbers = v.entity().select("novel_id", "name", "entity_no")
    hits = words.mentions(dramas.withColumn("content", F.lower("content")), ["drama_id", "novel_id"], "content", v.cast(), "novel_id")
    return dramas, hits.join(numbers, ["novel_id", "name"])


@query(f"""select c.doc_id drama_id, '第' || chapter_no || '-' || chapter_no || '章' title, coalesce(names, '') as names, '第 ' || chapter_no || ' 章（单章漫剧片段）' || case when n > 0 then '，出场角色 ' || n || ' 名，详见角色列表。' else '，暂未匹配到已有人物档案中的出场角色。' end summary, chapter_no = 1 has_scene
 from chapter c left join (select doc_id, count(*) n, string_agg(name, '、' order by entity_no) as names from {_HITS} group by 1) h on h.doc_id = c.doc_id""")
def drama_detail(v):
    """Dramas with their characters (ids exploded and joined) and whether a scene is saved (of first chapters, here)."""
    dramas, hits = _dramas(v)
    ids = hits.groupBy("drama_id").agg(F.collect_list("entity_no").alias("ids"))
    characters = v.entity().select("novel_id", "entity_no", "name")
    listed = dramas.drop("content").join(ids, "drama_id", "left")
    named = listed.select("drama_id", "novel_id", F.explode("ids").alias("entity_no")).join(characters, ["novel_id", "entity_no"]).groupBy("drama_id").agg(F.sort_array(F.collect_list(F.struct("entity_no", "name"))).alias("cs"))
    scenes = dramas.where("chapter_no = 1").select("drama_id", F.lit(True).alias("has_scene"))
    out = listed.join(named, "drama_id", "left").join(scenes, "drama_id", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    return out.select("drama_id", writing.drama_title(F.col("chapter_no"), F.col("chapter_no")).alias("title"), F.coalesce(F.array_join(F.transform("cs", lambda c: c["name"]), "、"), F.lit("")).alias("names"), writing.drama_summary(F.col("chapter_no"), n).alias("summary"), F.coalesce("has_scene", F.lit(False)).alias("has_scene"))


@query("""select doc_id drama_id, name, min(r) as rank from (select c.doc_id, e.name, 1 r from chapter c join entity e on c.novel_id = e.novel_id and e.type = 'character' and contains(c.content, e.name) union all select t.doc_id, e.name, 2 from token t join entity e on t.novel_id = e.novel_id and t.token = e.name and e.type = 'character') group by all""")
def drama_cast_ranked(v):
    """Names that the text contains, and then those that are among its tokens; each once, by its first rank."""
    dramas, _ = _dramas(v)
    cast = v.entity().where("type = 'character'").select("novel_id", "name")
    contained = words.mentions(dramas, ["drama_id"], "content", cast, "novel_id").select("drama_id", "name", F.lit(1).alias("rank"))
    tokens = v.token().select("novel_id", F.col("doc_id").alias("drama_id"), F.col("token").alias("name"))
    told = tokens.join(cast, ["novel_id", "name"], "left_semi").select("drama_id", "name", F.lit(2).alias("rank"))
    return contained.unionByName(told).groupBy("drama_id", "name").agg(F.min("rank").alias("rank"))


@query(f"""select doc_id drama_id, string_agg(name || '（角色，本章出场 ' || cast((length(t) - length(replace(t, name, ''))) / length(name) as bigint) || ' 次）', '、' order by entity_no) cast_block from (select h.*, lower(c.content) t from {_HITS} h join chapter c using (doc_id)) group by 1""")
def drama_cast_block(v):
    """What the director is told of a chapter's characters."""
    _, hits = _dramas(v)
    line = F.concat("name", F.lit("（角色，本章出场 "), F.col("n").cast("string"), F.lit(" 次）"))
    rows = hits.groupBy("drama_id").agg(F.sort_array(F.collect_list(F.struct("entity_no", line.alias("line")))).alias("ls"))
    return rows.select("drama_id", F.array_join(F.transform("ls", lambda x: x["line"]), "、").alias("cast_block"))


@query("""select event_id, case event_id % 4 when 3 then '' else 'a ' || user_id end scene, case event_id % 4 when 3 then '' else 'p1|p2' end plot, case event_id % 4 when 0 then 'c' when 1 then 'pan ' || user_id when 2 then 'c' else '' end camera, event_id % 4 = 3 fallback from events""")
def director_parse(v):
    """Replies of a director: whole, with the camera elsewhere in the object, with its name in the plot's tail, and no object at all."""
    uid = F.col("user_id").cast("string")
    head = F.concat(F.lit('{"scene_design":["a '), uid, F.lit('", ""],"plot_arrangement":["p1","p2'))
    replies = [
        F.concat(F.lit("```json\n"), head, F.lit('"],"camera_movement":["c"],"duration_estimate":"3"}\n```')),
        F.concat(head, F.lit('"],"more":{"camera_movement": ["pan '), uid, F.lit('"]}}')),
        F.concat(head, F.lit(', camera_movement: [x"],"camera_movement":["c"]}')),
        F.lit("Sorry, nothing came to mind."),
    ]
    raw = F.element_at(F.array(*replies), (F.col("event_id") % 4 + 1).cast("int"))
    d = v.table("events").select("event_id", J.director(raw).alias("d"))
    return d.select("event_id", F.array_join("d.scene", "|").alias("scene"), F.array_join("d.plot", "|").alias("plot"), F.array_join("d.camera", "|").alias("camera"), "d.fallback")


@query("""select novel_id, sha256(right(content, 1500)) context_sha, 'style=warm; ' || right(content, 20) prompt from chapter where (novel_id, chapter_no) in (select (novel_id, max(chapter_no)) from chapter group by novel_id)""")
def continue_context(v):
    """What a continuation goes on from, and the prompt made of it."""
    prompt = writing.filled("style={style}; {tail}", style=F.lit("warm"), tail=F.right("context", F.lit(20)))
    return writing.tail_context(v.chapter()).select("novel_id", F.sha2("context", 256).alias("context_sha"), prompt.alias("prompt"))


_VERSIONS = "(select doc_id version_id, novel_id, case when doc_id % 4 = 0 then 'own ' || doc_id end title, ['original', 'tense', 'warm', 'dry'][cast(doc_id % 4 as int) + 1] style, text as content from document where doc_id % 9 = 0)"


def _versions(v):
    styles = F.element_at(F.array(*map(F.lit, ("original", "tense", "warm", "dry"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return v.document().where("doc_id % 9 = 0").select(F.col("doc_id").alias("version_id"), "novel_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("own "), F.col("doc_id").cast("string"))).alias("title"), styles.alias("style"), F.col("text").alias("content"))


@query(f"""select version_id, style, length(trim(content)) word_count, substr(content, 1, 120) preview from {_VERSIONS}""")
def version_list(v):
    return _versions(v).select("version_id", "style", F.length(F.trim("content")).cast("long").alias("word_count"), F.substring("content", 1, 120).alias("preview"))


@query(f"""select version_id, v.novel_id, last + row_number() over (partition by v.novel_id order by version_id) chapter_no, coalesce(title, '续写·' || case style when 'original' then '原风格' when 'tense' then '悬疑' when 'warm' then '温情' else style end) title from {_VERSIONS} v join (select novel_id, max(chapter_no) last from chapter group by 1) c on c.novel_id = v.novel_id""")
def version_adopt(v):
    return writing.adopted(_versions(v), v.chapter().select("novel_id", "chapter_no")).select("version_id", "novel_id", "chapter_no", "title")


@query("""select novel_id, substr(split_part(replace(whole, chr(10), ' '), '.', 1), 1, 60) summary from (select novel_id, string_agg(substr(seg, 1, cast(6000 - before_ as int)), chr(10) || chr(10) order by chapter_no) whole from
 (select *, coalesce(sum(length(seg)) over (partition by novel_id order by chapter_no rows between unbounded preceding and 1 preceding), 0) before_ from (select novel_id, chapter_no, '【' || title || '】' || chr(10) || content seg from chapter)) where before_ < 6000 group by 1)""")
def novel_summary(v):
    """The model's summary of the first 6000 characters of each novel, at most 200 characters of it."""
    c = v.chapter().select("novel_id", "chapter_no", writing.marked(F.col("title"), F.col("chapter_no"), F.col("content")).alias("seg"))
    parts = tables.collect_capped(c, "novel_id", "seg", 6000, "chapter_no").groupBy("novel_id").agg(F.sort_array(F.collect_list(F.struct("chapter_no", "part"))).alias("ps"))
    asked = parts.select("novel_id", F.array_join(F.transform("ps", lambda p: p["part"]), "\n\n").alias("text"))
    return model_calls.call_model(asked, model_calls.stub_summary, "text", "summary", ["novel_id"]).select("novel_id", F.substring("summary", 1, 200).alias("summary"))


@query("""select event_id, 'x ' || user_id summary, case when event_id % 2 = 0 then '高潮' else '过渡' end plot_role, '平淡' emotional_tone, case when event_id % 3 = 0 then 'toc' else 'content' end as type from events""")
def analysis_records(v):
    """A model's analyses of chapters with what they lack filled in."""
    raw = F.to_json(F.struct(F.concat(F.lit("x "), F.col("user_id").cast("string")).alias("summary"), F.when(F.col("event_id") % 2 == 0, "高潮").otherwise("").alias("plot_role"), F.when(F.col("event_id") % 3 == 0, "toc").alias("type")))
    parsed = F.from_json(raw, "summary string, type string, plot_role string, emotional_tone string, climax_sentence string, connections string")
    return v.table("events").select("event_id", writing.analysis(parsed).alias("a")).select("event_id", "a.summary", "a.plot_role", "a.emotional_tone", "a.type")


@query("""select doc_id, '### ' || source || '（配角）' || chr(10) || '- 身份：' || lang || case when doc_id % 2 = 0 then chr(10) || '- 口头禅：oh' else '' end || chr(10) || chr(10) || 'no. ' || doc_id card from document""")
def character_cards(v):
    fields = {"name": F.col("source"), "role": F.lit(""), "identity": F.col("lang"), "personality": F.lit(" "), "catchphrase": F.when(F.col("doc_id") % 2 == 0, "oh"), "description": F.concat(F.lit("no. "), F.col("doc_id").cast("string"))}
    return v.document().select("doc_id", writing.card(fields).alias("card"))


@query("""select novel_id, name, coalesce(nullif(trim(role_), ''), '配角') as role, substr(case when entity_no % 5 = 0 then 'told of ' || name else 'own ' || name end, 1, 150) description, case when entity_no % 3 = 0 then 2 else 0 end n_events from (select novel_id, name, entity_no, case when entity_no % 2 = 0 then ' 主角' else '' end role_ from entity where entity_no % 10 <> 1)""")
def turbo_characters(v):
    """Characters of a quick analysis that are not there yet (every tenth is), with what the later steps told of them joined by name."""
    e = v.entity()
    found = e.select("novel_id", F.concat(F.lit(" "), F.col("name")).alias("name"), F.when(F.col("entity_no") % 2 == 0, " 主角").otherwise("").alias("role"), F.concat(F.lit("own "), F.col("name")).alias("description"))
    told = e.where("entity_no % 5 = 0").select("novel_id", F.concat("name", F.lit(" ")).alias("name"), F.concat(F.lit("told of "), F.col("name")).alias("description"))
    events = e.where("entity_no % 3 = 0").select("novel_id", "name", F.lit(2).alias("n_events"))
    return writing.save_characters(found, e.where("entity_no % 10 = 1"), told, events).withColumn("n_events", F.col("n_events").cast("int"))


@query("""select novel_id, name, freq from (select *, max(freq) over (partition by novel_id) most from entity where type = 'character') where freq >= 40 or most < 40""")
def fallback_candidates(v):
    """Candidates that are frequent enough; of a novel without any, all of them."""
    cast = v.entity().where("type = 'character'").select("novel_id", "name", "freq")
    most = cast.groupBy("novel_id").agg(F.max("freq").alias("most"))
    return cast.join(most, "novel_id").where("freq >= 40 or most < 40").select("novel_id", "name", "freq")


@query(f""", piece as (select novel_id, doc_id, piece_no, content from document join (select doc_id, row_number() over (partition by doc_id order by i) piece_no, content from (select doc_id, i, {TRIMMED.format("substr(text, cast(i * 800 + 1 as int), 800)")} content from (select doc_id, text, unnest(range(0, cast(ceil(greatest(0, length(text) - 800) / 800.0) as bigint) + 1)) i from document)) where length(content) > 0) using (doc_id)),
 named as (select novel_id, doc_id, piece_no, name, case length(name) % 3 when 0 then 'place' when 1 then 'org' else 'character' end type from (select novel_id, doc_id, piece_no, unnest(list_distinct(regexp_extract_all(lower(content), '\\p{{L}}+')[1:3])) as name from piece)),
 ent as (select novel_id, name, type, row_number() over (partition by novel_id order by doc_id, piece_no, name) id from (select novel_id, name, type, doc_id, piece_no, row_number() over (partition by novel_id, name, type order by doc_id, piece_no) place from named) where place = 1)
 select r.novel_id, a.id source_id, b.id target_id, 'knows' as type from (select novel_id, case when weight % 2 = 0 then target else source end source, case when weight % 2 = 0 then source else target end target from relation where weight % 3 <> 0) r join ent a on a.novel_id = r.novel_id and a.name = r.source join ent b on b.novel_id = r.novel_id and b.name = r.target""")
def graph_extract(v):
    """The whole extraction: a model's entities of every chunk, each name and type once and numbered; the heaviest co-occurrences qualified by a model, turned, and resolved to entities."""
    pieces = v.document().select("novel_id", "doc_id", F.posexplode(T.windows(F.col("text"), 800, 0)).alias("i", "c")).select("novel_id", "doc_id", "i", "c.content")

    def reads(texts):  # the stub of a model: the first three words of a chunk are its entities
        import json

        import regex

        types = ("place", "org", "character")
        return [json.dumps({"entities": [{"name": w, "type": types[len(w) % 3]} for w in regex.findall(r"\p{L}+", t.lower())[:3]]}, ensure_ascii=False) for t in texts]

    replies = model_calls.call_model(pieces, reads, "content", "reply", ["novel_id", "doc_id", "i"])
    items = replies.select("novel_id", "doc_id", "i", F.explode(F.from_json(J.outermost(F.col("reply")), "entities array<struct<name:string,type:string>>")["entities"]).alias("e"))
    found = items.select("novel_id", "doc_id", "i", F.trim("e.name").alias("name"), rules.entity_type(F.col("e.type")).alias("type")).where("name <> ''")
    first = found.groupBy("novel_id", "name", "type").agg(F.min(F.struct("doc_id", "i")).alias("at")).select("novel_id", "name", "type", "at.doc_id", "at.i")
    entities = tables.numbered(first, ["novel_id"], "doc_id", "id", then=("i", "name"))
    raw = v.relation().select("novel_id", "source", "target", F.when(F.col("weight") % 3 == 0, " ").otherwise("knows").alias("type"), F.when(F.col("weight") % 2 == 0, "B->A").otherwise("A->B").alias("direction"))
    return graph.connect(rules.directed(raw), entities, rules.ENTITY_TYPES)


@query("""select vec_id chunk_id, sha256(case when vec_id % 10 = 0 then 'edited ' || vec_id else text end) content_sha, vec_id % 10 = 0 edited, vec_id % 15 = 0 disabled from embeddings e join documents d on d.doc_id = e.vec_id""")
def chunk_edit(v):
    """Chunks with edits applied; an edited one is embedded anew and replaces its vector."""
    docs = v.document().select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    e = v.table("embeddings")
    chunks = e.select("vec_id", (F.col("vec_id") % 15 == 0).alias("disabled")).join(docs, "vec_id")
    edits = chunks.where("vec_id % 10 = 0").select("vec_id", F.concat(F.lit("edited "), F.col("vec_id").cast("string")).alias("content"))
    vectors = tables.upsert(e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), model_calls.embed(edits, "vec_id", "content").select("vec_id", "embedding"), ["vec_id"])
    return tables.patch(chunks, edits, "vec_id").join(vectors, "vec_id").select(F.col("vec_id").alias("chunk_id"), F.sha2("content", 256).alias("content_sha"), (F.size("embedding") == 8).alias("edited"), "disabled")


@query(f"""select task_id, seq, status from (select *, min(case when status <> 'running' then seq end) over (partition by task_id) ended from task_event) where seq <= coalesce(ended, seq)""")
def parse_progress(v):
    """A task's events up to its first end."""
    ended = v.task_event().where("status <> 'running'").groupBy("task_id").agg(F.min("seq").alias("ended"))
    return v.task_event().join(ended, "task_id", "left").where("ended is null or seq <= ended").select("task_id", "seq", "status")


@query(f"""select task_id, seq + 1000000 seq, 'running' status from {_TASKS} where status = 'failed' and task_id % 2 = 0""")
def retry_failed(v):
    """Tasks that are asked to run again (even ids): only those that have failed do, by a new event."""
    now = tables.latest(v.task_event(), ["task_id"], F.desc("seq"))
    return now.where("task_id % 2 = 0 and status = 'failed'").select("task_id", (F.col("seq") + 1000000).alias("seq"), F.lit("running").alias("status"))


@query("""select task_id, cast(sum(seq % 100) as bigint) tokens_in, cast(sum(seq % 10) as bigint) tokens_out, count(*) filter (where status = 'failed') failed from task_event group by 1""")
def step_sums(v):
    return v.task_event().groupBy("task_id").agg(F.sum(F.col("seq") % 100).alias("tokens_in"), F.sum(F.col("seq") % 10).alias("tokens_out"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("""select id, attempts, needs_review from (select event_id id, case when event_id % 5 = 0 then 3 when event_id % 3 = 0 then 1 when event_id % 3 = 2 then 2 else 3 end attempts, event_id % 5 = 0 needs_review from events)""")
def char_retry_loop(v):
    """Analyse, validate, and try again up to twice; what still fails is kept for review. Each round's replies are stored."""
    rounds = storage.Rounds(v.spark, storage.scratch(v.spark, "char-retry"))
    items = v.table("events").select(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("prompt"))

    def model(r):
        return lambda prompts: ["bad" if int(p) % 5 == 0 or (int(p) + r) % 3 else "good" for p in prompts]

    out = model_calls.retry_loop(items, "id", "prompt", model, lambda df: df.withColumn("ok", F.col("reply") == "good"), rounds.stored)
    return out.select("id", "attempts", "needs_review")


@query("""select event_id from events where event_id % 2 = 0 and event_id % 6 <> 0 and event_id % 10 <> 0""")
def retry_gaps(v):
    """Rejected once, and since then neither passed nor rejected again."""
    e = v.table("events").select("event_id")
    return model_calls.still_missing(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), e.where("event_id % 10 = 0"), "event_id")


@query("""select key, reply, strftime(created_at, '%Y-%m-%d') as day from (select key, arg_max(reply, (created_at, event_id)) reply, max(created_at) created_at from (select event_type || ':' || user_id as key, 'r' || event_id reply, ts created_at, event_id from events) where created_at >= (select max(ts) from events) - interval 10 day and not starts_with(key, 'error') group by 1)""")
def memo_ttl(v):
    """Entries of a cache that are not too old, without those of a prefix that was cleared."""
    e = v.table("events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.struct(F.col("ts"), F.col("event_id")).alias("at"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reply"), F.col("ts").alias("created_at"))
    now = v.table("events").agg(F.max("ts").alias("now"))
    memo = model_calls.without_prefix(e.join(F.broadcast(now), F.lit(True)), "error")  # one row
    live = model_calls.fresh(memo.withColumn("reply", F.struct("at", "reply")), F.col("now"), "10 days")
    return live.select("key", F.col("reply.reply").alias("reply"), F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("""select n_nationkey::varchar as key, case when n_nationkey % 5 = 0 then 'env ' || n_name when n_nationkey % 3 = 0 then 'file ' || n_name else n_name end as value, case when n_nationkey % 5 = 0 then 0 when n_nationkey % 3 = 0 then 1 else 2 end layer from nation""")
def config_layers(v):
    """Settings: the environment's before the file's before the defaults."""
    n = v.table("nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("key"), "n_name")
    layer = lambda df, head: df.select("key", F.concat(F.lit(head), F.col("n_name")).alias("value"))
    return tables.layered(layer(n.where("n_nationkey % 5 = 0"), "env "), layer(n.where("n_nationkey % 3 = 0"), "file "), layer(n, ""))


@query("""select owner_id, 'favourite' action, doc_id::varchar target, '{"target_id":' || doc_id || ',"lang":"' || lang || '"}' detail from document where doc_id % 3 = 0""")
def audit_log(v):
    return sinks.audit_rows(v.document().where("doc_id % 3 = 0").select("owner_id", F.col("doc_id").alias("target_id"), "lang"), "favourite")


@query("""select label kb_id, count(*) n from embeddings where label <> 4 group by 1""")
def drop_collection(v):
    """A base's vectors after its collection has gone; of the others nothing goes."""
    e = v.table("embeddings").select(F.col("label").alias("kb_id"), "vec_id")
    gone = v.spark.createDataFrame([(4,), (4,), (-1,)], "kb_id int")
    return tables.delete_cascade({"vectors": e}, gone, "kb_id", {"vectors": "kb_id"})["vectors"].groupBy("kb_id").agg(F.count("*").alias("n"))


@query("""select label kb_id, string_agg(vec_id, ',' order by vec_id) ids from embeddings group by 1""")
def ids_by_collection(v):
    ids = v.table("embeddings").groupBy(F.col("label").alias("kb_id")).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return ids.select("kb_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


_SKILLS = "(select c_custkey id, 'skill ' || c_custkey as name, case when c_custkey % 4 <> 0 then c_nationkey end owner, c_custkey % 5 = 0 builtin, c_custkey % 3 <> 0 enabled, case c_custkey % 3 when 0 then 'global' when 1 then 'continue_write' else 'chat' end scene from customer)"


def _skills(v):
    k = F.col("c_custkey")
    template = F.when(k % 7 == 0, "Broken {{ name").otherwise(F.concat(F.lit("Use {{ name }} for {{ style }}, no. "), k.cast("string")))
    return v.table("customer").select(k.alias("id"), F.concat(F.lit("skill "), k.cast("string")).alias("name"), F.when(k % 4 != 0, F.col("c_nationkey")).alias("owner"), (k % 5 == 0).alias("builtin"), (k % 6 != 0).alias("enabled"), F.when(k % 3 == 0, "global").when(k % 3 == 1, "continue_write").otherwise("chat").alias("scene"), template.alias("template"))


@query(f"""select id, '{{"name":"' || name || '","scene":"' || scene || '"}}' line from {_SKILLS} where (owner = 3 or owner is null) and not builtin""")
def skill_export(v):
    """One's own and the global skills that are not built in."""
    seen = _skills(v).where("(owner = 3 or owner is null) and not builtin")
    return seen.select("id", F.to_json(F.struct("name", "scene")).alias("line"))


@query("""select 'skill ' || c_custkey as name, 'chat' scene, 'Do {{ x }} ' || c_custkey template from customer where c_custkey % 6 not in (0, 1, 2)""")
def skill_import(v):
    """Skills from lists of JSON objects; those without a name or a template, or with one that is broken, are passed over."""
    k = F.col("c_custkey")
    good = F.to_json(F.struct(F.concat(F.lit("skill "), k.cast("string")).alias("name"), F.lit("chat").alias("scene"), F.concat(F.lit("Do {{ x }} "), k.cast("string")).alias("template")))
    bad = F.when(k % 6 == 0, '{"name":"","template":"x"}').when(k % 6 == 1, '{"name":"no template"}').otherwise('{"name":"broken","template":"{{ x"}')
    raw = F.concat(F.lit("["), F.when(k % 6 < 3, bad).otherwise(good), F.lit("]"))
    return rules.importable_skills(v.table("customer").select(raw.alias("raw")))


@query(f"""select id, 'Use ' || name || ' for warm, no. ' || id hint from {_SKILLS} where (owner = 3 or owner is null) and id % 6 <> 0 and scene in ('global', 'continue_write') and id % 7 <> 0""")
def skill_mount(v):
    """Hints of enabled skills for a scene, rendered; a skill whose template is broken is passed over."""
    seen = _skills(v).where("(owner = 3 or owner is null) and enabled and scene in ('global', 'continue_write')").where(rules.template_valid(F.col("template")))
    values = F.create_map(F.lit("name"), F.col("name"), F.lit("style"), F.lit("warm"))
    return seen.select("id", rules.render(F.col("template"), values).alias("hint"))


@query("""select c_custkey id, case when c_custkey % 7 = 0 then '' else 'name,style' end variables, c_custkey % 7 <> 0 valid from customer""")
def template_variables(v):
    s = _skills(v)
    return s.select("id", F.array_join(rules.template_variables(F.col("template")), ",").alias("variables"), rules.template_valid(F.col("template")).alias("valid"))


@query("""select event_id, case event_id % 4 when 3 then 0 when 2 then 1 else 2 end n, case event_id % 4 when 3 then '' when 2 then '{"name":"' || user_id || '"}' else '{"name":"a"}' end head from events""")
def as_list(v):
    """Items of an array, of an array inside an object, of an object alone, and of no JSON."""
    uid = F.col("user_id").cast("string")
    items = F.concat(F.lit('[{"name":"a"},{"name":"'), uid, F.lit('"}]'))
    raw = F.element_at(F.array(items, F.concat(F.lit('{"n":1,"people":'), items, F.lit("}")), F.concat(F.lit('{"name":"'), uid, F.lit('"}')), F.lit("none")), (F.col("event_id") % 4 + 1).cast("int"))
    xs = v.table("events").select("event_id", J.as_list(raw).alias("xs"))
    return xs.select("event_id", F.size("xs").alias("n"), F.coalesce(F.get("xs", 0), F.lit("")).alias("head"))


@query("""select novel_id, minutes, minutes > 10 or novel_id % 7 = 0 is_long, strftime(timestamp '2024-02-01 00:00:00' + minutes * interval 1 minute, '%Y-%m-%d %H:%M') completes from (select novel_id, case when novel_id % 5 = 0 then case when novel_id % 7 = 0 then 10 end else greatest(1, cast(ceil(sum(word_count) / 2400.0) as bigint)) end as minutes from document group by 1)""")
def estimate_completion(v):
    """When a task ends by its estimate; without words (here every fifth novel) only tasks of a long kind (every seventh) have one."""
    words = v.document().groupBy("novel_id").agg(F.sum("word_count").alias("n")).select("novel_id", F.when(F.col("novel_id") % 5 != 0, F.col("n")).alias("words"))
    minutes, is_long = dashboard.estimate(F.col("words"), 2400, F.col("novel_id") % 7 == 0)
    ends = dashboard.completed_at(F.lit("2024-02-01 00:00:00").cast("timestamp"), minutes)
    return words.select("novel_id", minutes.alias("minutes"), F.when(minutes.isNotNull() | is_long, is_long).alias("is_long"), F.date_format(ends, "yyyy-MM-dd HH:mm").alias("completes"))


@query("""select event_id, case when length(event_type) > 6 then 'type;' else '' end || case when user_id % 10 = 0 then 'user;' else '' end || case when event_type not in ('view', 'click', 'purchase') then 'kind;' else '' end errors from events""")
def input_errors(v):
    """All rules that a row breaks: lengths, ranges, allowed values."""
    checks = {"type": F.length("event_type").between(1, 6), "user": F.col("user_id") % 10 != 0, "kind": F.col("event_type").isin("view", "click", "purchase")}
    return v.table("events").select("event_id", F.concat(*[F.when(ok, "").otherwise(f"{name};") for name, ok in checks.items()]).alias("errors"))


@query("""select d.doc_id, d.novel_id kb_id from document d join (select distinct novel_id from linked) k on k.novel_id = d.novel_id where d.owner_id = 2 and not d.deleted and d.status = 'done'""")
def kb_documents_valid(v):
    """Documents that may go into their novel's base: the owner's, not deleted, parsed."""
    own = v.document().where("owner_id = 2 and not deleted and status = 'done'")
    return own.join(v.link().select(F.col("kb_id").alias("novel_id")).distinct(), "novel_id", "left_semi").select("doc_id", F.col("novel_id").alias("kb_id"))


@query("""select doc_id, case when doc_id % 3 = 0 then 'edited' else title end title, case when doc_id % 3 = 0 then 5 else length(content) end word_count from chapter""")
def chapter_correct(v):
    """Chapters with corrections applied; the count of characters follows the content."""
    c = v.chapter().select("doc_id", "title", "content")
    changes = c.where("doc_id % 3 = 0").select("doc_id", F.lit("edited").alias("title"), F.lit("abcde").alias("content"))
    return tables.patch(c, changes, "doc_id").select("doc_id", "title", F.length("content").cast("long").alias("word_count"))


@query("""select novel_id, chapter_no, n from (select novel_id, chapter_no, length(content) n from chapter where chapter_no not in (2, 3, 4) union all select novel_id, 2, sum(length(content)) + 2 * (count(*) - 1) from chapter where chapter_no in (2, 3, 4) group by 1 having count(*) >= 2 union all select novel_id, chapter_no, length(content) from chapter where chapter_no = 2 and novel_id in (select novel_id from chapter group by 1 having max(chapter_no) = 2))""")
def chapter_merge_rows(v):
    """Chapters 2 to 4 as one, under the first one's number; the others keep theirs."""
    c = v.chapter().select("novel_id", "chapter_no", "content")
    some = c.where("chapter_no between 2 and 4")
    merged = some.groupBy("novel_id").agg(F.count("*").alias("k"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chapter_no", "content"))), lambda x: x["content"]), "\n\n").alias("content")).where("k >= 2")
    left = c.join(some.join(merged.select("novel_id"), "novel_id", "left_semi").select("novel_id", "chapter_no"), ["novel_id", "chapter_no"], "left_anti")
    return left.unionByName(merged.select("novel_id", F.lit(2).cast("long").alias("chapter_no"), "content")).select("novel_id", "chapter_no", F.length("content").cast("long").alias("n"))


def _export(v):
    kb = v.novel().select(F.col("novel_id").alias("kb_id"), F.col("source").alias("name"))
    rows = _chunks(v, 800, 0).join(v.link(), "doc_id")
    return kb, rows.select("kb_id", (F.col("doc_id") * 1000 + F.col("piece_no")).alias("chunk_id"), "doc_id", F.lit(None).cast("long").alias("chapter_id"), F.col("piece_no").alias("idx"), F.length("content").cast("long").alias("word_count"), "content")


@query(f"""select kb_id, c.doc_id * 1000 + piece_no chunk_id, c.doc_id, piece_no idx, n word_count, content_sha from ({_chunk_sql(800, 0)}) c join linked l on l.doc_id = c.doc_id""")
def export_csv(v):
    """The bases' exports as CSV files, read back."""
    _, chunks = _export(v)
    path = storage.scratch(v.spark, "export-csv")
    sinks.export_csv(chunks, path, "kb_id")
    return sinks.read_csv(v.spark, path, "kb_id long").select("kb_id", "chunk_id", "doc_id", "idx", "word_count", F.sha2("content", 256).alias("content_sha"))


@query(f""", c as (select kb_id, c.doc_id, piece_no, n, row_number() over (partition by kb_id order by c.doc_id, piece_no) place from ({_chunk_sql(800, 0)}) c join linked l on l.doc_id = c.doc_id)
 select novel_id kb_id, 0 part, null::bigint doc_id, null::bigint idx, '{{"knowledge_base":{{"kb_id":' || novel_id || ',"name":"' || source || '"}},"chunks":[' line from novel union all select novel_id, 2, null, null, ']}}' from novel
 union all select kb_id, 1, doc_id, piece_no, case when place = 1 then '' else ',' end || '{{"doc_id":' || doc_id || ',"idx":' || piece_no || ',"word_count":' || n || '}}' from c""")
def export_json(v):
    """The lines of each base's export, which together are one object."""
    kb, chunks = _export(v)
    return sinks.json_lines(kb, chunks.select("kb_id", "doc_id", "idx", "word_count"))


@query(f"""select kb_id, c.doc_id, piece_no idx, n word_count, content_sha from ({_chunk_sql(800, 0)}) c join linked l on l.doc_id = c.doc_id""")
def export_json_files(v):
    """The bases' exports as JSON files with the contents, read back chunk by chunk."""
    kb, chunks = _export(v)
    path = storage.scratch(v.spark, "export-json")
    sinks.export_json(kb, chunks.select("kb_id", "doc_id", "idx", "word_count", "content"), path)
    return sinks.read_json_chunks(v.spark, path, "doc_id long, idx long, word_count long, content string").select("kb_id", "doc_id", "idx", "word_count", F.sha2("content", 256).alias("content_sha"))


_PROFILES = """(select s_name as name, ['主角', '配角', '反派', '路人'][cast(s_suppkey % 4 as int) + 1] as role_, case when s_suppkey % 9 = 0 then ' ' else 'merchant' end identity_,
 case when s_suppkey % 11 = 0 then repeat('x', 151) when s_suppkey % 13 = 0 then '' else 'a merchant of nation ' || s_nationkey || ' who deals in goods of kind ' || (s_suppkey % 7) || ' and is not known to anybody beyond the harbour' end description from supplier)"""


@query(f"""select a.name, case when role_ = '路人' then 'role' when trim(identity_) = '' then 'identity' when length(description) not between 1 and 150 then 'description' when d.name is not null then 'duplicate' else '' end reason from {_PROFILES} a left join
 (with fit as (select name, role_, description, list_distinct(list_transform(range(1, length(description)), lambda i: substr(description, i, 2))) g from {_PROFILES} where role_ <> '路人' and length(description) between 1 and 150)
 select distinct x.name from fit x join fit y on x.role_ = y.role_ and (length(y.description), y.name, y.description) < (length(x.description), x.name, x.description) and len(list_intersect(x.g, y.g)) / len(list_distinct(x.g || y.g)) > 0.9) d on d.name = a.name""")
def profiles_judged(v):
    """Profiles of characters with the first rule that they break; descriptions alike count once."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("a merchant of nation "), F.col("s_nationkey").cast("string"), F.lit(" who deals in goods of kind "), (k % 7).cast("string"), F.lit(" and is not known to anybody beyond the harbour"))
    role = F.element_at(F.array(*map(F.lit, ("主角", "配角", "反派", "路人"))), (k % 4 + 1).cast("int"))
    p = v.table("supplier").select(F.col("s_name").alias("name"), role.alias("role"), F.when(k % 9 == 0, " ").otherwise("merchant").alias("identity"), F.when(k % 11 == 0, F.repeat(F.lit("x"), F.lit(151))).when(k % 13 == 0, "").otherwise(text).alias("description"))
    return rules.judge_profiles(p).select("name", F.coalesce("reason", F.lit("")).alias("reason"))


@query("""select doc_id, seq from (select doc_id, row_number() over (order by doc_id) seq from document where owner_id = 1 and not deleted) where seq > 100 and seq <= 120""")
def document_seek(v):
    """The sixth page of an owner's documents, sought by counts of ranges of the id."""
    own = tables.filtered(v.document(), owner_id=1, deleted=False).select("doc_id")
    return tables.seek(own, 6, 20, "doc_id", span=50)


@query("""select event_id, case event_id % 6 when 2 then 2 when 0 then 1 when 1 then 1 else 0 end n, case when event_id % 6 < 3 then cast(user_id as varchar) else '' end k from events""", "")
def json_replies(v):
    """What replies hold: fenced, behind prose with brackets, an array of objects, cut off, empty, and with braces in the prose."""
    n = F.col("user_id").cast("string")
    one = F.concat(F.lit('{"k": '), n, F.lit("}"))
    replies = F.array(F.concat(F.lit("Here it is:\n```json\n"), one, F.lit("\n```\nDone.")), F.concat(F.lit("As in [1], the answer: "), one), F.concat(F.lit("["), one, F.lit(', {"k": 7}]')), F.concat(F.lit('{"k": '), n, F.lit(', "x": [1, 2')), F.lit(""), F.concat(F.lit("I {think} so: "), one))
    text = J.tolerant(F.element_at(replies, (F.col("event_id") % 6 + 1).cast("int")))
    items = v.table("events").select("event_id", J.as_list(text).alias("xs")).select("event_id", F.filter("xs", lambda x: x != "{}").alias("xs"))
    return items.select("event_id", F.size("xs").alias("n"), F.coalesce(F.get_json_object(F.get("xs", 0), "$.k"), F.lit("")).alias("k"))
