"""Readers of nested documents: calendar events, block trees, typed properties, mail parts, document JSON, archives, notes with front matter, transcripts.

Flat JSON is read by built-in functions. Trees of any depth are walked by Arrow functions, one document a row. What can't be read is null or left out,
never an error of the whole job.
"""

from __future__ import annotations

import base64
import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.functions.arrow import arrow_function
from tessella.sources import tables as T

#: The most files and unpacked bytes of an archive, and folders that are no notes.
MOST_FILES, MOST_BYTES, EXCLUDED = 5_000, 200 * 1024 * 1024, (".obsidian", ".trash", ".git")

_EVENT = (
    "struct<id:string,summary:string,description:string,location:string,attendees:array<struct<email:string>>,start:struct<date:string,dateTime:string>,"
    "end:struct<date:string,dateTime:string>,recurrence:array<string>,recurringEventId:string,created:string,updated:string,status:string>"
)


def calendar_events(df: DataFrame, raw: str) -> DataFrame:
    """The columns of `df`, then source_id, title, content, participants, start_time, end_time, location, is_all_day, is_recurring, created_at, updated_at.
    Events without an id are left out."""
    e = df.withColumn("_e", F.from_json(raw, _EVENT)).where(F.coalesce("_e.id", F.lit("")) != "")
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    title = F.coalesce("_e.summary", F.lit("(Kein Titel)"))
    content = F.concat_ws("\n\n", filled(title), filled(F.col("_e.description")), F.concat(F.lit("Ort: "), filled(F.col("_e.location"))))
    when = lambda side: F.coalesce(filled(F.col(f"_e.{side}.dateTime")), filled(F.col(f"_e.{side}.date")), F.lit(""))
    people = F.filter(F.transform(F.coalesce("_e.attendees", F.array()), lambda a: a["email"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return e.select(
        *df.columns, F.col("_e.id").alias("source_id"), title.alias("title"), F.when(content == "", title).otherwise(content).alias("content"), people.alias("participants"),
        when("start").alias("start_time"), when("end").alias("end_time"), F.coalesce("_e.location", F.lit("")).alias("location"),
        (F.col("_e.start.date").isNotNull() & F.col("_e.start.dateTime").isNull()).alias("is_all_day"),
        ((F.size(F.coalesce("_e.recurrence", F.array())) > 0) | (F.coalesce("_e.recurringEventId", F.lit("")) != "")).alias("is_recurring"),
        F.try_to_timestamp("_e.created").alias("created_at"), F.try_to_timestamp("_e.updated").alias("updated_at"),
    )


def _loaded(x: str | None):
    try:
        return json.loads(x) if x else None
    except ValueError:
        return None


def _plain(rich) -> str:
    return "".join(str(r.get("plain_text", "")) for r in rich if isinstance(r, dict)) if isinstance(rich, list) else ""


#: Fixed formats: what stands before the text of a block.
_PREFIX = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> "}


def block_lines(block: dict, depth: int = 0) -> Iterator[str]:
    """Markdown lines of a block and, further in, of its children."""
    kind = str(block.get("type", ""))
    data, margin = block.get(kind), "  " * depth
    if not isinstance(data, dict):
        if kind == "divider":
            yield margin + "---"
        return
    text, caption = _plain(data.get("rich_text")), _plain(data.get("caption"))
    file = data.get("external") or data.get("file")
    url = str(file.get("url", "")) if isinstance(file, dict) else ""
    icon = data.get("icon")
    emoji = icon.get("emoji") if isinstance(icon, dict) else None
    shapes = {
        "to_do": lambda: f"- {'[x]' if data.get('checked') else '[ ]'} {text}",
        "toggle": lambda: f"> **{text}**",
        "callout": lambda: "> " + (f"{emoji} " if isinstance(emoji, str) else "") + text,
        "code": lambda: f"```{data.get('language', '')}\n{margin}{text}\n{margin}```",
        "divider": lambda: "---",
        "image": lambda: f"![{caption}]({url})" if url else f"[Image: {caption}]",
        "child_page": lambda: f"[Page: {data.get('title', '')}]",
        "child_database": lambda: f"[Database: {data.get('title', '')}]",
        "bookmark": lambda: f"[{caption or data.get('url', '')}]({data.get('url', '')})",
        "equation": lambda: f"$${data.get('expression', '')}$$",
    }
    own = shapes[kind]() if kind in shapes else _PREFIX.get(kind, "") + text
    if own or kind in _PREFIX or kind == "paragraph":
        yield margin + own
    for child in block.get("_children") or []:
        yield from (line for line in block_lines(child, depth + 1) if line)


@arrow_function("string")
def blocks_markdown(blocks: pd.Series) -> pd.Series:
    """Markdown of a JSON array of blocks, those with text parted by a blank line."""
    return blocks.map(lambda x: "\n\n".join(p for p in ("\n".join(block_lines(b)) for b in _loaded(x) or [] if isinstance(b, dict)) if p))


def _mentions(blocks) -> Iterator[dict]:
    for b in blocks if isinstance(blocks, list) else []:
        data = b.get(str(b.get("type", "")))
        for r in (data.get("rich_text") or []) if isinstance(data, dict) else []:
            m = r.get("mention") if isinstance(r, dict) and r.get("type") == "mention" else None
            kind = m.get("type") if isinstance(m, dict) else None
            if kind in ("user", "page", "database") and isinstance(m.get(kind, {}), dict):
                yield {"type": kind, "id": str(m.get(kind, {}).get("id", "")), "name": str(m.get(kind, {}).get("name", "")) if kind == "user" else None}
        yield from _mentions(b.get("_children"))


@arrow_function("array<struct<type:string,id:string,name:string>>")
def block_mentions(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda x: list(_mentions(_loaded(x))))


def _property(p: dict) -> list[str]:
    kind = str(p.get("type", ""))
    v = p.get(kind)
    if kind == "rich_text":
        return [t] if (t := _plain(v)) else []
    if kind in ("select", "status"):
        return [v["name"]] if isinstance(v, dict) and isinstance(v.get("name"), str) else []
    if kind == "multi_select":
        return [str(i.get("name", "")) for i in v if isinstance(i, dict)] if isinstance(v, list) else []
    if kind == "date":
        return [v["start"]] if isinstance(v, dict) and isinstance(v.get("start"), str) else []
    if kind in ("url", "email"):
        return [v] if isinstance(v, str) else []
    if kind == "checkbox":
        return [str(v)] if isinstance(v, bool) else []
    return [str(v)] if kind == "number" and v is not None else []


@arrow_function("struct<title:string,values:map<string,array<string>>>")
def page_properties(props: pd.Series) -> pd.DataFrame:
    """The title of a page and its other properties as lists of values; single values are lists of one."""
    titles, values = [], []
    for x in props:
        loaded = _loaded(x)
        each = {k: p for k, p in loaded.items() if isinstance(p, dict)} if isinstance(loaded, dict) else {}
        titles.append(next((_plain(p.get("title")) for p in each.values() if p.get("type") == "title"), "") or "(Kein Titel)")
        values.append({k: v for k, p in each.items() if p.get("type") != "title" and (v := _property(p))})
    return pd.DataFrame({"title": titles, "values": values})


def _parts(part: dict) -> str:
    if part.get("mimeType") == "text/plain":
        body = part.get("body")
        data = body.get("data") if isinstance(body, dict) else None
        try:
            return base64.urlsafe_b64decode(data + "==").decode("utf-8", "replace") if isinstance(data, str) and data else ""
        except ValueError:
            return ""
    return "\n".join(t for p in part.get("parts") or [] if isinstance(p, dict) and (t := _parts(p)))


@arrow_function("string")
def mail_text(payload: pd.Series) -> pd.Series:
    """Plain text of a message's tree of parts."""
    return payload.map(lambda x: _parts(p) if isinstance(p := _loaded(x), dict) else "")


_HEADINGS = {f"HEADING_{i}": "#" * i + " " for i in range(1, 7)} | {"TITLE": "# ", "SUBTITLE": "## "}


def _paragraph(p: dict) -> str:
    text = "".join(str((e.get("textRun") or {}).get("content", "")) for e in p.get("elements") or []).rstrip("\n")
    if not text.strip():
        return ""
    if isinstance(p.get("bullet"), dict):
        return "  " * int(p["bullet"].get("nestingLevel", 0)) + "- " + text
    return _HEADINGS.get((p.get("paragraphStyle") or {}).get("namedStyleType", ""), "") + text


@arrow_function("string")
def document_markdown(doc: pd.Series) -> pd.Series:
    """Markdown of a word processor's document JSON: headings, bullets, and tables with a rule below their first row."""

    def one(x: str | None) -> str:
        out = []
        for e in ((_loaded(x) or {}).get("body") or {}).get("content") or []:
            if isinstance(e.get("paragraph"), dict):
                out.append(_paragraph(e["paragraph"]))
            elif isinstance(e.get("table"), dict):
                rows = [[" ".join(t for c in cell.get("content") or [] if (t := _paragraph(c.get("paragraph") or {}).strip())) for cell in r.get("tableCells") or []] for r in e["table"].get("tableRows") or []]
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                out.append("\n".join([*lines[:1], *(["| " + " | ".join("---" for _ in rows[0]) + " |"] if rows else []), *lines[1:]]))
        return "\n\n".join(p for p in out if p)

    return doc.map(one)


def zip_path(name: str) -> str | None:
    """A clean relative path of a Markdown file, or none."""
    parts = [p for p in PurePosixPath(name).parts if p not in (".", "..", "/", "\\")]
    return "/".join(parts) if parts and parts[-1].lower().endswith(".md") and not set(parts[:-1]) & set(EXCLUDED) else None


@arrow_function("struct<error:string,files:array<struct<path:string,content:string>>>")
def zip_notes(data: pd.Series) -> pd.DataFrame:
    """Markdown files of an archive; beyond the bounds, or where it can't be read, an error and no files."""
    errors, files = [], []
    for x in data:
        error, found, size = None, [], 0
        try:
            with zipfile.ZipFile(io.BytesIO(x or b"")) as z:
                for info in z.infolist():
                    path = None if info.is_dir() else zip_path(info.filename)
                    if path is None:
                        continue
                    size += info.file_size
                    if size > MOST_BYTES or len(found) >= MOST_FILES:
                        error, found = "too large" if size > MOST_BYTES else "too many files", []
                        break
                    found.append({"path": path, "content": z.read(info).decode("utf-8", "replace")})
        except (zipfile.BadZipFile, OSError):
            error, found = "not an archive", []
        errors.append(error)
        files.append(found)
    return pd.DataFrame({"error": errors, "files": files})


_FRONT = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"


def front_matter(raw: Column) -> tuple[Column, Column]:
    """A map of the plain `key: value` lines between `---` lines, and the rest. Lists of values stay as text. Deeper YAML isn't read."""
    head = F.regexp_extract(raw, _FRONT, 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']|[\"']$", "").alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first), C.stripped(F.regexp_replace(raw, _FRONT, ""))


def vault_documents(files: DataFrame, path: str, raw: str, modified: str, deleted: str | None = None) -> DataFrame:
    """The columns of `files`, then source_id, title, tags, links, created, content, is_deleted. Title and date of the front matter come before
    the file's name and time; its tags before those of the text. A deleted file is a tombstone with its name and no content."""
    meta, content = front_matter(F.col(raw))
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    m = files.withColumn("_m", meta).withColumn("content", F.when(gone, "").otherwise(content))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md$", "")
    listed = F.transform(F.split(F.regexp_replace(F.coalesce(F.col("_m")["tags"], F.lit("")), r"^\[|\]$", ""), ","), lambda t: F.regexp_replace(F.trim(t), "^[\"']|[\"']$", ""))
    tags = F.array_distinct(F.concat(F.filter(listed, lambda t: t != ""), T.hashtags(F.col("content"))))
    return m.select(
        *files.columns, F.col(path).alias("source_id"), F.when(gone, stem).otherwise(F.coalesce(F.nullif(F.col("_m")["title"], F.lit("")), stem)).alias("title"), F.when(gone, F.array().cast("array<string>")).otherwise(tags).alias("tags"),
        T.wikilinks(F.col("content")).alias("links"), F.coalesce(F.col("_m")["date"], F.col(modified)).alias("created"), "content", gone.alias("is_deleted"),
    )


_CUE = r"^\d{2}:\d{2}:\d{2}[.,]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[.,]\d{3}"


def _spoken_lines(content: Column) -> Column:
    lines = F.transform(F.split(F.regexp_replace(content, r"\r\n?", "\n"), "\n"), lambda x: C.stripped(x))
    return F.filter(lines, lambda x: (x != "") & (x != "WEBVTT") & ~x.rlike(r"^\d+$") & ~x.rlike(_CUE))


def spoken(content: Column | str) -> Column:
    """The lines of a VTT or SRT transcript with their speakers' names: header, cue numbers and times go."""
    return F.array_join(_spoken_lines(F.col(content) if isinstance(content, str) else content), "\n")


def voices(content: Column | str) -> Column:
    """Speakers, sorted: what stands before the first `: ` of a line, if under 100 characters and no number."""
    lines = _spoken_lines(F.col(content) if isinstance(content, str) else content)
    names = F.transform(F.filter(lines, lambda x: F.instr(x, ": ") > 1), lambda x: F.trim(F.substring_index(x, ": ", 1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: (F.length(n) < 100) & (n != "") & ~n.rlike(r"^\d+$"))))


def recordings(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Meetings (uuid, topic, start_time, files array<struct<user_name,user_email,file_name,recording_type>>, transcript, name), each once and none of `seen`
    (uuid), as (uuid, title, content, participants, speakers): addresses come before names, and speakers are united with them, sorted."""
    new = df.dropDuplicates(["uuid"]).join(seen.select("uuid"), "uuid", "left_anti")
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    person = F.transform(F.coalesce("files", F.array()), lambda f: F.coalesce(some(f["user_email"]), some(f["user_name"])))
    audio = F.transform(F.coalesce("files", F.array()), lambda f: F.when(f["recording_type"] == "participant_audio", some(f["file_name"])))
    people = F.array_distinct(F.filter(F.concat(person, audio), lambda x: x.isNotNull()))
    kind = T.transcript_format(F.col("name"), F.col("transcript"))
    timed = kind.isin("vtt", "srt")
    speakers = F.when(timed, voices("transcript")).otherwise(F.array().cast("array<string>"))
    content = F.when(timed, spoken("transcript")).otherwise(C.stripped(F.col("transcript")))
    return new.select("uuid", F.coalesce("topic", F.lit("")).alias("title"), content.alias("content"), F.array_sort(F.array_union(people, speakers)).alias("participants"), speakers.alias("speakers"))


def cursor(raw: Column) -> Column:
    """(watermark, page) of a stored cursor: a JSON pair, or a plain token or time."""
    pair = F.from_json(raw, "struct<watermark:string,next_page_token:string>")
    return F.when(raw.startswith("{") & pair.isNotNull() & (pair["watermark"].isNotNull() | pair["next_page_token"].isNotNull()), F.struct(pair["watermark"].alias("watermark"), pair["next_page_token"].alias("page"))).otherwise(F.struct(F.nullif(raw, F.lit("")).alias("watermark"), F.lit(None).cast("string").alias("page")))
