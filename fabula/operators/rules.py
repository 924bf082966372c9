"""Checks and mappings on what users and models hand in, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.text import bigram_jaccard, bigrams

#: Entity types in the order of priority, and what else models call them.
ENTITY_TYPES = ("character", "place", "org", "time_period", "event", "item", "concept")
TYPE_ALIASES = {
    "person": "character", "people": "character", "人": "character", "角色": "character",
    "location": "place", "位置": "place", "场景": "place",
    "organization": "org", "组织": "org", "势力": "org", "帮派": "org",
    "time": "time_period", "时间": "time_period", "时期": "time_period", "时代": "time_period",
    "事件": "event", "情节": "event",
    "object": "item", "物品": "item", "道具": "item", "武器": "item",
    "概念": "concept", "设定": "concept",
}

#: Words that are no names, and what is said of an error by its class or where nothing else fits.
STOP_WORDS = tuple("的 了 是 在 我 你 他 她 它 们 这 那 有 和 与 及 也 都 就 而 等 着 过 又 个 之 其".split())
ERROR_CLASSES = {
    "TimeoutError": "模型服务响应超时，请检查网络或更换模型（后台任务超时）",
    "CancelledError": "任务已被取消",
    "ConnectionError": "连接模型服务失败，请检查模型地址是否可访问",
    "ConnectionRefusedError": "模型服务拒绝连接，请确认模型服务已启动",
}
UNKNOWN_ERROR, ERROR_PREFIX = "未知错误，请稍后重试", "系统错误："

#: The roles that a profile may name, and the bounds of this library's own rules.
#: Keywords of errors that are broadcast at most; a longer list is refused.
MOST_KEYWORDS = 10_000
ROLES = ("主角", "配角", "反派")
DESCRIPTION_LIMIT, SAME_DESCRIPTION = 150, 0.9


def entity_type(raw: Column) -> Column:
    """A known type, an alias's type, or `character`."""
    t = F.lower(F.trim(raw))
    aliases = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    return F.coalesce(F.when(t.isin(*ENTITY_TYPES), t), F.try_element_at(aliases, t), F.lit("character"))


def valid_name(name: Column) -> Column:
    """Two to six characters, no stop word, and not digits alone."""
    return F.length(name).between(2, 6) & ~name.isin(*STOP_WORDS) & ~name.rlike("^[0-9]+$")


def user_error(errors: DataFrame, keywords: DataFrame, text: str = "error", kind: str | None = None, limit: int = 200) -> DataFrame:
    """`errors` with a message for users.

    In this order: the text of an error whose class (`kind`) is BizError; what ERROR_CLASSES says of the class; that of
    the keyword (keyword, message, priority) found in the text with least priority, or the text where that message is
    null; the text on one line, cut to `limit`, behind a prefix. All keywords go along as one broadcast list in the
    order of priority, then of keyword; none is left out, and more than MOST_KEYWORDS are refused.
    """
    if keywords.limit(MOST_KEYWORDS + 1).count() > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords are too many to be broadcast")
    one = keywords.select(F.struct("priority", F.lower("keyword").alias("keyword"), "message").alias("k")).where("k.keyword is not null")
    known = one.agg(F.array_sort(F.collect_list("k")).alias("known_keywords"))
    found = F.get(F.filter("known_keywords", lambda k: F.contains(F.lower(text), k["keyword"])), 0)
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\s+", " "))
    cut = F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).when(flat == "", UNKNOWN_ERROR).otherwise(flat)
    message = F.when(found.isNotNull(), F.coalesce(found["message"], F.col(text))).otherwise(F.concat(F.lit(ERROR_PREFIX), cut))
    if kind:
        classes = F.create_map(*[F.lit(x) for kv in ERROR_CLASSES.items() for x in kv])
        message = F.when(F.col(kind) == "BizError", F.col(text)).otherwise(F.coalesce(F.try_element_at(classes, F.col(kind)), message))
    return errors.join(F.broadcast(known), F.lit(True)).withColumn("message", message).drop("known_keywords")  # one row


def directed(relations: DataFrame) -> DataFrame:
    """(source, target, type, ...) with ends swapped where direction is B->A; without a type a row goes."""
    back = F.col("direction") == "B->A"
    kept = relations.where(F.trim(F.coalesce("type", F.lit(""))) != "")
    return kept.withColumns({"source": F.when(back, F.col("target")).otherwise(F.col("source")), "target": F.when(back, F.col("source")).otherwise(F.col("target"))}).drop("direction")


def valid_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (novel_id, source, target, type) whose ends are two entities of the novel, each once."""
    names = entities.select("novel_id", "name").distinct()
    ok = relations.where("source <> target and trim(coalesce(type, '')) <> ''")
    for end in ("source", "target"):
        ok = ok.join(names.withColumnRenamed("name", end), ["novel_id", end], "left_semi")
    return ok.select("novel_id", "source", "target", "type").distinct()


def alike_texts(texts: DataFrame, least: float) -> DataFrame:
    """(role, a, b): pairs of `texts` (role, place struct<..., description>, all different) of one role whose bigrams are alike above `least`.

    Complete: where sets are alike, the smaller one's size times (1 - least) / least bounds how many bigrams only one
    of them has. Dealt by hash to more parts than that, the sets have one part in common at least. Each text has the
    parts that its own size asks for, and to meet smaller ones those that their sizes ask for.
    """
    few = lambda size: F.floor(size * F.lit((1 - least) / least)).cast("int") + 1
    sets = texts.select("role", "place", bigrams(F.col("place.description")).alias("grams")).withColumn("size", F.size("grams"))

    def pieces(side: str, fewest: Column) -> DataFrame:
        part = lambda i: F.struct(i.alias("part"), F.array_sort(F.filter("grams", lambda g: F.pmod(F.xxhash64(g), F.col("k")) == i)).alias("piece"))
        counts = sets.withColumn("k", F.explode(F.sequence(fewest, few(F.col("size")))))
        rows = counts.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), part)))
        return rows.select("role", "k", "p.part", "p.piece", F.col("place").alias(side), F.col("size").alias(f"size_{side}"))

    smallest = F.floor(F.col("size") * F.lit(least)).cast("int")
    met = pieces("a", few(F.col("size"))).join(pieces("b", few(smallest)), ["role", "k", "part", "piece"])
    sizes = (F.col("size_a") <= F.col("size_b")) & (F.col("size_a") >= F.col("size_b") * F.lit(least)) & (F.col("a.description") != F.col("b.description"))
    return met.where(sizes).select("role", "a", "b").distinct().where(bigram_jaccard(F.col("a.description"), F.col("b.description")) > least)


def judge_profiles(profiles: DataFrame) -> DataFrame:
    """(name, role, identity, description) with `ok` and `reason`: role, identity and length of the description, and no two alike.

    A description is a duplicate if one of its role that comes before by (length, name, description) is alike, whatever
    lies between them; of equal ones with equal names, all but one. Equal descriptions are looked at once.
    """
    place = lambda name: F.struct(F.length("description").alias("length"), F.col(name).alias("name"), "description")
    fits = F.col("role").isin(*ROLES) & F.length("description").between(1, DESCRIPTION_LIMIT)
    # structs, as their least counts a null name
    texts = profiles.where(fits).groupBy("role", "description").agg(F.min(F.struct("name")).alias("first")).select("role", "description", place("first.name").alias("place"))
    pairs = alike_texts(texts.select("role", "place"), SAME_DESCRIPTION)
    both = pairs.select("role", "a.description", F.col("b").alias("place")).unionByName(pairs.select("role", "b.description", F.col("a").alias("place")))
    before = texts.unionByName(both).groupBy("role", "description").agg(F.min("place").alias("before"))
    again = F.row_number().over(Window.partitionBy("role", "description", "name").orderBy("identity")) > 1
    reason = (
        F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "role")
        .when(F.trim(F.coalesce("identity", F.lit(""))) == "", "identity")
        .when(~F.coalesce(F.length("description").between(1, DESCRIPTION_LIMIT), F.lit(False)), "description")
        .when(F.col("again") | (F.col("before") < place("name")), "duplicate")
    )
    found = profiles.withColumn("again", again).join(before, ["role", "description"], "left")
    return found.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).select(*profiles.columns, "reason", "ok")


def template_variables(template: Column) -> Column:
    """The names between double braces, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit("\\{\\{\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*\\}\\}"), F.lit(1))))


def template_valid(template: Column) -> Column:
    """Whether every double brace that opens closes again, around one name."""
    bare = F.regexp_replace(template, "\\{\\{\\s*[A-Za-z_][A-Za-z0-9_]*\\s*\\}\\}", "")
    return ~F.contains(bare, F.lit("{{")) & ~F.contains(bare, F.lit("}}"))


def importable_skills(lists: DataFrame, raw: str = "raw") -> DataFrame:
    """(name, scene, template) of the JSON lists in `raw`: those with a name and a template that is valid."""
    kind = "array<struct<name:string,scene:string,template:string>>"
    items = lists.select(F.explode(F.from_json(raw, kind)).alias("x")).select("x.*")
    return items.where((F.trim("name") != "") & (F.trim("template") != "") & template_valid(F.col("template")))


def render(template: Column, values: Column) -> Column:
    """`{{ name }}` replaced from a map, by nothing where it lacks the name: pieces between marks, each with its value."""
    pieces = F.split(template, "\\{\\{")
    filled = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.when(F.contains(p, F.lit("}}")), F.concat(F.coalesce(F.try_element_at(values, F.trim(F.substring_index(p, "}}", 1))), F.lit("")), F.substring(p, F.locate("}}", p) + 2, F.length(p)))).otherwise(F.concat(F.lit("{{"), p)),
    )
    return F.concat(F.get(pieces, 0), F.array_join(filled, ""))
