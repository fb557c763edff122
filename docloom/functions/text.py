"""Text expressions. All regular expressions are Unicode-aware; ``trim`` strips any white space, not only blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import DEFAULT_SECTION

#: Fixed patterns.
SENTENCE_BOUNDARY = r"(?U)(?<=[.!?])\s+|(?<=[.!?])\[web:\d+\]\s*|(?<=\n)\s*(?=\S)"
NUMBER_ONLY = r"(?U)^\d+\.$"
CITATION_ONLY = r"(?U)^(\[\s*[wW][eE][bB]\s*:\s*\d+\s*\]\s*)+$"
NUMBERED_ITEM = r"(?U)^\d+\.\s+\S"
DEFINITION_ITEM = r"(?U)^[A-Z][A-Za-z ]+:\s"
PAGE_FOOTER = r"(?iU)^(?:page\s+)?\d+\s*(?:[-–/of]*\s*\d+)?\.?\s*$"
COURSE_OUTCOME = r"(?U)^[cC][oO]?\d+\s*\(\s*\d+\s*\)\s*$"
DIAGRAM_LABELS = ("START", "END", "STOP")
NUMBERED_HEADING = r"(?U)^\d+(?:\.\d+)*\.?\s+[A-Z][^.!?]{0,100}$"
HEADING_NUMBER = r"(?U)^(\d+(?:\.\d+)*)\.?\s+"
SEQUENCE_QUESTION = r"(?iU)\b(steps?|process|procedure|sequence|stages?|how\s+to)\b"
WORD = r"[a-zA-Z][a-zA-Z0-9_-]{1,}"
TERM = r"[\p{L}\p{N}]+"
NUMBERED_INSIDE = r"(?U)(?:^|\s)\d+\.\s"
CITATIONS = r"(?i)CITATIONS:\s*\[([0-9,\s]*)\]"
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for many uses inside ``body``."""
    return F.transform(F.array(value), body)[0]


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; the ends are stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def casefold(text: Column) -> Column:
    """Lower case with the sharp s spelled out, which agrees with full case folding for Western European text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normal_form(text: Column) -> Column:
    """What decides whether two passages are the same text."""
    return casefold(collapse(F.coalesce(text, F.lit(""))))


def n_lines(text: Column) -> Column:
    """Lines as a text file counts them: a final line break opens no line; an empty text has none."""
    body = F.regexp_replace(text, f"(?:{LINE_BREAKS})$", "")
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.size(F.split(body, LINE_BREAKS, -1)))


def raw_sentences(text: Column) -> Column:
    """Non-empty stripped parts between sentence boundaries."""
    return F.filter(F.transform(F.split(text, SENTENCE_BOUNDARY, -1), trim), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentences: a lone item number joins the part after it, whatever that is; parts of citation tags only go."""

    def joined(parts: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("number"))

        def step(state: Column, part: Column) -> Column:
            with_number = F.struct(F.concat(state["done"], F.array(F.concat_ws(" ", state["number"], part))).alias("done"), F.lit(None).cast("string").alias("number"))
            held = F.struct(state["done"].alias("done"), part.alias("number"))
            plain = F.struct(F.concat(state["done"], F.array(part)).alias("done"), F.lit(None).cast("string").alias("number"))
            return F.when(state["number"].isNotNull(), with_number).when(part.rlike(NUMBER_ONLY), held).when(part.rlike(CITATION_ONLY), state).otherwise(plain)

        folded = F.aggregate(parts, start, step, lambda s: F.when(s["number"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["number"]))))
        special = F.exists(parts, lambda p: p.rlike(NUMBER_ONLY) | p.rlike(CITATION_ONLY))
        return F.when(special, folded).otherwise(parts)

    return let(raw_sentences(text), joined)


def is_junk(text: Column) -> Column:
    """Extraction noise: no content, page footers, citation tags, grading tags, diagram labels."""
    bare = trim(text)
    return (
        (bare == "")
        | ~bare.rlike(r"[\p{L}\p{N}]")
        | ((F.length(bare) <= 12) & bare.rlike(PAGE_FOOTER))
        | bare.rlike(CITATION_ONLY)
        | bare.rlike(COURSE_OUTCOME)
        | bare.isin(*DIAGRAM_LABELS)
    )


def stem(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.endswith("es") & (n > 4), F.substring(word, F.lit(1), n - 2))
        .when(word.endswith("s") & (n > 3), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def lexical_tokens(text: Column) -> Column:
    """Distinct stems of the ASCII words of three letters or more."""
    words = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(words, lambda w: stem(F.lower(w))))


def terms(text: Column) -> Column:
    """All index terms in order: lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), F.lit(1))


def heading_level_of_style(style: Column) -> Column:
    return F.coalesce(F.regexp_extract(style, r"(\d+)", 1).try_cast("int"), F.lit(1))


def explicit_level(title: Column, heading_level: Column) -> Column:
    """A positive level given by the parser, else one more than the dots of a heading number, else null."""
    number = F.regexp_extract(title, HEADING_NUMBER, 1)
    return F.when(heading_level > 0, heading_level).when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)


def embedding_text(section: Column, text: Column) -> Column:
    """The text with its section before it, unless that says nothing."""
    bare = trim(F.coalesce(section, F.lit("")))
    return F.when((bare != "") & (bare != DEFAULT_SECTION) & (bare != text), F.concat(bare, F.lit("\n"), text)).otherwise(text)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^./]+)$", 1))


def upload_path(folder: Column, name: Column, token: Column | None = None) -> Column:
    """Where an upload is kept: its name alone, without the folders that a client may send, behind a random token."""
    token = F.replace(F.uuid(), F.lit("-"), F.lit("")) if token is None else token
    return F.concat(folder, F.lit("/"), token, F.lit("_"), base_name(F.replace(name, F.lit("\\"), F.lit("/"))))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^./]+$", "")


def is_section_name(text: Column) -> Column:
    """Short capitalised lines of plain words, as tables of contents have."""
    return (
        F.length(text).between(2, 45)
        & text.rlike(r"^[A-Za-z][A-Za-z &'\-/]*$")
        & text.rlike(r"^\p{Lu}")
        & (F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")) >= 2)
    )


def is_pdf_heading(text: Column, max_size: Column, bold: Column, body_size: Column) -> Column:
    n = F.length(text)
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    label = words.between(1, 8) & text.rlike(r"^\p{Lu}") & ~text.rlike(r"[.,:;!?()]")
    sized = ((max_size >= body_size + 1.5) & (n <= 80)) | (bold & (n <= 60)) | label | text.rlike(NUMBERED_HEADING)
    return n.between(2, 120) & ~trim(text).rlike(r"^\p{N}+$") & F.when(body_size <= 0, bold & (n <= 80)).otherwise(sized)


def numbered_items(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(NUMBERED_INSIDE))


def sequence_score(text: Column, section: Column) -> Column:
    """How likely a chunk is the procedure that a question about steps wants."""
    low, low_section = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(section, F.lit("")))
    items = F.regexp_count(low, F.lit(NUMBERED_INSIDE))
    tags = F.regexp_count(low, F.lit(r"\[web:"))
    zero = F.lit(0)
    return (
        items * 10
        + F.when(low.contains("step") | low_section.contains("step"), F.lit(5)).otherwise(zero)
        - F.when(low.rlike("^(explain |what is |describe )"), F.lit(20)).otherwise(zero)
        - F.when((items >= 2) & (tags >= items - 1), F.lit(200)).otherwise(zero)
        - F.when(low_section.contains("reference"), F.lit(200)).otherwise(zero)
    )


def citation(source: Column, payload: dict[str, Column]) -> Column:
    """``file — detail, detail``; a detail is left out where its field is null, empty or zero.

    payload: source_type, page, section, sheet, paragraph, table, table_row_start, table_row_end, chunk_index, chunk_count.
    """

    def some(name: str, label: str) -> Column:
        value = payload[name]
        shown = value.isNotNull() & (value.cast("string") != "") & (value.cast("string") != "0")
        return F.when(shown, F.concat(F.lit(label), value.cast("string")))

    details = F.concat_ws(
        ", ",
        F.when(payload["source_type"].isin("pdf", "structured_document"), some("page", "page ")),
        some("section", "Section: "),
        some("sheet", "Sheet: "),
        some("paragraph", "paragraph "),
        some("table", "Table "),
        F.when(payload["table_row_start"].isNotNull() & payload["table_row_end"].isNotNull(), F.concat(F.lit("rows "), payload["table_row_start"].cast("string"), F.lit("–"), payload["table_row_end"].cast("string"))),
        F.when(payload["chunk_index"].isNotNull() & (payload["chunk_count"] > 0), F.concat(F.lit("chunk "), (payload["chunk_index"] + 1).cast("string"), F.lit(" of "), payload["chunk_count"].cast("string"))),
    )
    name = base_name(F.coalesce(source, F.lit("unknown")))
    return F.when(details != "", F.concat(name, F.lit(" — "), details)).otherwise(name)


def split_citations(content: Column) -> tuple[Column, Column]:
    """(answer, sorted distinct passage numbers): the last citation line ends the answer; without one all is answer."""
    found = F.regexp_extract_all(content, F.lit(CITATIONS), F.lit(1))
    last = F.element_at(found, -1)
    numbers = F.transform(F.filter(F.split(last, r"[,\s]+"), lambda t: t.rlike(r"^\d+$")), lambda t: t.cast("int"))
    head = F.regexp_extract(content, r"(?is)^(.*)CITATIONS:\s*\[[0-9,\s]*\]", 1)
    has = F.size(found) > 0
    return trim(F.when(has, head).otherwise(content)), F.when(has, F.array_sort(F.array_distinct(numbers))).otherwise(F.array().cast("array<int>"))


def chat_title(at: Column) -> Column:
    """Default name of a new chat: its time in India."""
    return F.concat(F.lit("Document chat — "), F.date_format(F.from_utc_timestamp(at, "+05:30"), "dd MMM yyyy, HH:mm"))


def has_default_title(name: Column) -> Column:
    return name.startswith("Document chat —")


def upload_title(names: Column) -> Column:
    """The first upload's stem, and how many more there are."""
    return F.when(F.size(names) == 1, file_stem(names[0])).otherwise(F.concat(file_stem(names[0]), F.lit(" + "), (F.size(names) - 1).cast("string"), F.lit(" more")))


def preview(text: Column, characters: int = 220) -> Column:
    return F.substring(collapse(F.coalesce(text, F.lit(""))), 1, characters)


def zoom(height: Column, least: float = 0.0) -> Column:
    """Magnification that renders a region about 48 pixels high, between 3 and 8 unless ``least`` asks for more."""
    return F.greatest(F.lit(least), F.least(F.lit(8.0), F.greatest(F.lit(3.0), F.ceil(F.lit(48.0) / F.greatest(height, F.lit(1.0))).cast("double"))))
