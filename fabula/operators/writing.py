"""What is written around a novel: prompts, continuations, cards of characters, single-chapter dramas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.operators.tables import numbered

#: Labels of styles, of a card's lines, and the defaults of a chapter's analysis.
STYLES = {"original": "原风格", "tense": "悬疑", "warm": "温情"}
CARD_LINES = {"gender": "性别", "identity": "身份", "personality": "性格", "appearance": "外貌", "catchphrase": "口头禅"}
ANALYSIS = {"type": "content", "plot_role": "过渡", "emotional_tone": "平淡", "climax_sentence": "", "connections": ""}


def filled(template: str, **values: Column) -> Column:
    """A prompt with `{name}` replaced by each of the values, null by nothing."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def marked(title: Column, number: Column, content: Column) -> Column:
    """A chapter under its title in brackets, or under its number where it has none."""
    return F.concat(F.lit("【"), F.coalesce(F.when(title != "", title), F.concat(F.lit("第"), number.cast("string"), F.lit("章"))), F.lit("】\n"), content)


def tail_context(chapters: DataFrame, limit: int = 1500) -> DataFrame:
    """(novel_id, context): the end of each novel's last chapter (novel_id, chapter_no, content)."""
    last = chapters.groupBy("novel_id").agg(F.max("chapter_no").alias("chapter_no"))
    return chapters.join(last, ["novel_id", "chapter_no"], "left_semi").select("novel_id", F.right("content", F.lit(limit)).alias("context"))


def adopted(versions: DataFrame, chapters: DataFrame) -> DataFrame:
    """Versions (version_id, novel_id, title, style, content) as chapters behind the novel's last one, in the order of their ids."""
    labels = F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv])
    last = chapters.groupBy("novel_id").agg(F.max("chapter_no").alias("last"))
    nth = numbered(versions.select("novel_id", "version_id"), ["novel_id"], "version_id", "nth").select("version_id", "nth")
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("续写·"), F.coalesce(F.try_element_at(labels, F.col("style")), F.col("style"))))
    return versions.join(nth, "version_id").join(last, "novel_id", "left").select("version_id", "novel_id", (F.coalesce("last", F.lit(0)) + F.col("nth")).cast("long").alias("chapter_no"), title.alias("title"), "content", F.length(F.trim("content")).cast("long").alias("word_count"))


def card(fields: dict[str, Column]) -> Column:
    """A character's card in Markdown: the name and role, a line for each field that is not blank, the description."""
    lines = [F.when(F.trim(fields[k]) != "", F.concat(F.lit(f"- {label}："), F.trim(fields[k]))) for k, label in CARD_LINES.items() if k in fields]
    description = F.when(F.trim(fields["description"]) != "", F.concat(F.lit("\n"), F.trim(fields["description"]))) if "description" in fields else F.lit(None).cast("string")
    head = F.concat(F.lit("### "), F.coalesce(fields["name"], F.lit("未知")), F.lit("（"), F.coalesce(F.when(fields["role"] != "", fields["role"]), F.lit("配角")), F.lit("）"))
    return F.concat_ws("\n", head, *lines, description)


def drama_title(first: Column, last: Column) -> Column:
    return F.concat(F.lit("第"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("章"))


def drama_summary(chapter_no: Column, characters: Column) -> Column:
    base = F.concat(F.lit("第 "), chapter_no.cast("string"), F.lit(" 章（单章漫剧片段）"))
    return F.when(characters > 0, F.concat(base, F.lit("，出场角色 "), characters.cast("string"), F.lit(" 名，详见角色列表。"))).otherwise(F.concat(base, F.lit("，暂未匹配到已有人物档案中的出场角色。")))


def analysis(parsed: Column, summary_limit: int = 120) -> Column:
    """A chapter's analysis record (a struct of strings) with its defaults and with the summary cut."""
    fields = [F.coalesce(F.when(parsed[k] != "", parsed[k]), F.lit(v)).alias(k) for k, v in ANALYSIS.items()]
    return F.struct(F.substring(F.coalesce(parsed["summary"], F.lit("")), 1, summary_limit).alias("summary"), *fields)


def save_characters(found: DataFrame, existing: DataFrame, experiences: DataFrame, events: DataFrame) -> DataFrame:
    """`found` (novel_id, name, role, description; merged, so each name once) that `existing` (novel_id, name) lacks, as rows to insert.

    A description of `experiences` (novel_id, name, description) goes before the own one; `events` (novel_id, name, n_events).
    Names are trimmed; blank ones go; descriptions are cut to 150 characters.
    """
    clean = found.withColumn("name", F.trim("name")).where("name <> ''").join(existing.select("novel_id", "name"), ["novel_id", "name"], "left_anti")
    told = experiences.where(F.trim("description") != "").select("novel_id", F.trim("name").alias("name"), F.trim("description").alias("told"))
    out = clean.join(told, ["novel_id", "name"], "left").join(events.select("novel_id", F.trim("name").alias("name"), "n_events"), ["novel_id", "name"], "left")
    return out.select("novel_id", "name", F.coalesce(F.when(F.trim("role") != "", F.trim("role")), F.lit("配角")).alias("role"), F.substring(F.coalesce("told", F.trim("description")), 1, 150).alias("description"), F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"))
