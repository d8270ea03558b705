"""Text functions: cutting, names, symbols, structured replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a symbol pattern finds by mistake.
NOISY_SYMBOLS = ["", "the", "a", "an", "is", "of", "to", "and", "or"]
#: Folders whose names tell nothing.
NOISE_FOLDERS = ["/", "Users", "home", "root", "var", "tmp", "opt", "usr", "workspace", "projects", "repos", "code", "dev", "Documents", "Desktop", "Downloads", "src", "."]
SYMBOL = r"\b(?:fn|def|class|impl)\s+([A-Za-z_][A-Za-z0-9_]*)"
ERROR_CODE = r"\b(?:E\d{3,}|[45]\d{2})\b"


#: A token is a run of letters of any script, or of digits.
TOKEN = r"\p{L}+|[0-9]+"
PLAN_FILE = r"[\w/.-]+\.(rs|mjs|ts|json|md|toml|yaml|yml|py|sh)\b"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order, unstemmed."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def cut(text: Column, size: int, mark: str = "…") -> Column:
    """The first ``size`` characters, with a mark if there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def first_bytes(text: Column, size: int) -> Column:
    """The longest start of a text that takes at most ``size`` bytes and cuts no character."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("t"), F.lit(True).alias("on"))
    step = lambda a, c: F.when(a["on"] & (a["n"] + F.octet_length(c) <= size), F.struct((a["n"] + F.octet_length(c)).alias("n"), F.concat(a["t"], c).alias("t"), F.lit(True).alias("on"))).otherwise(F.struct(a["n"].alias("n"), a["t"].alias("t"), F.lit(False).alias("on")))
    whole = F.when(F.octet_length(text) <= size, text)
    return F.coalesce(whole, F.aggregate(F.split(F.substring(text, 1, size), ""), start, step, lambda a: a["t"]))


def cut_at_word(text: Column, size: int) -> Column:
    """Cut at the last blank of the first ``size`` characters, if that keeps over half of them."""
    head = F.substring(text, 1, size)
    words = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    short = F.when(F.length(words) > size // 2, words).otherwise(head)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(short, F.lit("…")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_command(command: Column) -> Column:
    """The first line that is neither empty nor a comment, up to a pipe among its first 80 characters, or 80."""
    line = F.coalesce(F.get(F.filter(F.transform(F.split(command, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")), F.lit(0)), command)
    pipe = F.instr(line, "|")
    return F.trim(F.when((pipe > 0) & (pipe <= 80), F.substring(line, F.lit(1), pipe - 1)).otherwise(F.substring(line, 1, 80)))


def last_lines(output: Column, count: int = 3, size: int = 200) -> Column:
    """The last lines joined by bars, cut; a trailing line feed ends the last line."""
    lines = F.split(F.regexp_replace(output, "\n$", ""), "\n")
    return cut(F.array_join(F.slice(lines, -F.least(F.size(lines), F.lit(count)), count), " | "), size)


def path_keywords(files: Column, tool: Column) -> Column:
    """Directories of the files that tell something, their extensions, and the tool, in order."""
    folders = lambda f: F.filter(F.split(F.regexp_replace(f, "/?[^/]*$", ""), "/"), lambda p: (F.octet_length(p) > 2) & ~p.isin(NOISE_FOLDERS))
    extension = lambda f: F.filter(F.array(F.regexp_extract(basename(f), r"^.+\.([^.]+)$", 1)), lambda e: e != "")
    return F.array_distinct(F.concat(F.flatten(F.transform(files, lambda f: F.concat(folders(f), extension(f)))), F.array(F.lower(tool))))


def symbols(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(1))
    return F.array_distinct(F.filter(found, lambda s: ~F.lower(s).isin(NOISY_SYMBOLS)))


def error_codes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ERROR_CODE), F.lit(0)))


def json_slice(reply: Column) -> Column:
    """From the first opening brace to the last closing one; null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def xml_all(reply: Column, tag: str) -> Column:
    return F.regexp_extract_all(reply, F.lit(f"(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def xml_facts(reply: Column) -> Column:
    """Facts of a reply with their confidence; 0.5 where that is no number."""
    parts = F.regexp_extract_all(reply, F.lit(r'(?s)(<fact confidence="[^"]*">.*?</fact>)'), F.lit(1))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"(?s)>(.*)</fact>$", 1).alias("fact"),
            F.coalesce(F.regexp_extract(p, 'confidence="([^"]*)"', 1).try_cast("double"), F.lit(0.5)).alias("confidence"),
        ),
    )


def author_parts(author: Column) -> tuple[Column, Column]:
    """Name and address of ``Name <address>``; without an address all is the name."""
    address = F.regexp_extract(author, r"<([^>]*)>", 1)
    return F.trim(F.regexp_replace(author, r"\s*<[^>]*>\s*$", "")), address


def plan_title(content: Column, file_name: Column) -> Column:
    """The first heading of a plan, or its file name."""
    found = F.regexp_extract(content, r"(?m)^# (.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(file_name)


def plan_files(content: Column, most: int = 20) -> Column:
    """Files that a plan refers to: its first ``most`` references, each once."""
    return F.array_distinct(F.slice(F.regexp_extract_all(content, F.lit(PLAN_FILE), F.lit(0)), 1, most))


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "-"), "^-|-$", "")


def plan_keywords(content: Column) -> Column:
    """The first ten file references in lower case and slugs of the first five sections, those of over two characters."""
    named = F.transform(F.slice(F.regexp_extract_all(content, F.lit(PLAN_FILE), F.lit(0)), 1, 10), lambda f: F.lower(f))
    headings = F.slice(F.regexp_extract_all(content, F.lit(r"(?m)^##\s+(.+)$"), F.lit(1)), 1, 5)
    return F.array_distinct(F.concat(named, F.filter(F.transform(headings, slug), lambda s: F.length(s) > 2)))


def plan_content(content: Column, size: int = 8000) -> Column:
    return cut(content, size, "\n\n[...truncated]")


def listwise_prompt(query: str, titles: Column, narratives: Column, size: int = 240) -> Column:
    """What a listwise reranker is asked: numbered documents with snippets of ``size`` characters."""
    lines = F.transform(F.arrays_zip(titles.alias("t"), narratives.alias("n")), lambda x, i: F.concat(i.cast("string"), F.lit(". "), x["t"], F.lit(" — "), F.substring(F.coalesce(x["n"], F.lit("")), 1, size), F.lit("\n")))
    ask = F.concat(F.lit('\nRespond with strict JSON: {"order": [indices 0..'), (F.size(titles) - 1).cast("string"), F.lit(", each exactly once, best first]}"))
    return F.concat(F.lit(f'Query: "{query}"\n\nDocuments:\n'), F.array_join(lines, ""), ask)


def pretty_json(rows: Column) -> Column:
    """Rows as indented JSON, as language models are shown them."""
    return F.to_json(rows, {"pretty": "true"})


def permutation_scores(order: Column, count: Column) -> Column:
    """Scores (n - rank) / n by item of a listwise order; null unless it is a permutation of 0..n-1."""
    valid = (F.size(order) == count) & (F.array_sort(order) == F.sequence(F.lit(0), count - 1))
    return F.when(valid, F.transform(order, lambda item, rank: F.struct(item.alias("item"), ((count - rank) / count).alias("score"))))
