"""Problem 5: telling files that nobody wrote by hand from hand-written source.

Method: layout statistics of each chunk (longest and mean line, share of white space, of letters and
digits, of numeric literals and of long encoded runs, mean length of names, share of repeated lines) are
summed by file and held against thresholds of its language, which were fitted on labelled files and held
against ten times as many others (README). Names and folders that tools and package managers use, and the
notices that they leave at the head of a file, decide what the layout leaves open, copies of ordinary
source above all. All of it is JVM expressions; a row shrinks to a few numbers before anything is exchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import spread

# Folders of package managers, of copied libraries and of tools' output.
FOLDERS = ("node_modules", "bower_components", "jspm_packages", "site-packages", "vendor", "third_party", "third-party", "thirdparty", "__generated__", "generated", "gen", "autogen", "dist")
# Endings of names (before the extension) that tools give their output.
ENDINGS = (r"[.-]min", r"\.bundle", r"(\.[0-9a-f]{6,})?\.chunk", r"\.g", r"[._]generated", r"[._]pb", r"_pb2", r"\.designer")
#: Configuration is never a case.
CONFIGURATION = ("yml", "yaml", "json", "toml", "tf", "env", "properties", "xml", "sh", "sql", "ini", "cfg", "conf")
FOLDER = "(?i)(^|/)(" + "|".join(FOLDERS) + ")/"
NAME = "(?i)(" + "|".join(ENDINGS) + r")\.[a-z0-9]+$"
_COMMENT = r"(?im)^[ \t]*(//|/\*|\*|#|<!--|--)"
# How tools say that they made a file, and that edits are lost, in several languages.
MADE = (
    r"\b(auto(matically)?[ -]?)?(generated|produced|emitted) (by|from|with|using)\b",
    r"\bautogenerated file\b",
    r"@generated\b",
    r"<auto-?generated\b",
    r"\b(edits|changes)( here)? (are not preserved|(are|will be) (lost|overwritten|discarded))\b",
    r"\bdo not (edit|modify|change)( this file| by hand| manually| directly)?[ .!*/-]*$",
    r"(erzeugt|generiert)\b.*\bnicht (von hand |manuell )?(bearbeiten|ändern|editieren)",
    r"(wurde|ist) (automatisch )?(von|mit|aus) [^ ]+ (erzeugt|generiert)",
    r"(généré|générée|produit|produite)( automatiquement)? (par|avec|à partir)",
    r"\bne pas (modifier|éditer)\b",
    r"(generado|generada|creado|gerado|gerada)( automáticamente| automaticamente)? (por|con|com|a partir)",
    r"\bno (editar|modificar)\b",
    r"(generato|generata) (da|con|automaticamente)",
    r"(сгенерирован|создан)[а-я]* (автоматически|с помощью|из)|не (редактировать|изменять)",
    r"自动生成|自動生成",
)
#: A tool's notice in a comment: who made the file, or that edits are lost.
TOOL = _COMMENT + r"(.*(" + "|".join(MADE) + r")|[*!# /-]*generator: *[^ \r\n])"
#: A copied library's notice: where it comes from, or its name with version and licence.
COPY = _COMMENT + r"(.*\bvendored copy of\b|.*\bcopied (unchanged|verbatim) from\b|[*! ]*@license [^ ]+ v?[0-9]+\.[0-9]|[*! ]*[^ ]+ v[0-9]+\.[0-9][^ ]* \| \(c\))"
#: Parts of a library's banner; two of them together count.
BANNER = tuple(_COMMENT + r"[*! ]*" + part for part in (r"(licensed|released) under\b", r"version: *v?[0-9]+\.[0-9]", r"copyright (\(c\) )?[0-9]{4}.* (authors|contributors)\b"))
ENCODED = r"[A-Za-z0-9+/=]{100,}"
#: The same, tried only where a run begins; a shorter run is then read once, not once from each place in it.
ENCODED_ONCE = r"(?<![A-Za-z0-9+/=])" + ENCODED
NUMBER = r"\b(0x[0-9a-fA-F]+|[0-9][0-9.eE]*)"
#: Lines that are always searched for notices; a comment that a text begins with is searched to its end.
HEAD_LINES = 12
_MARK = r"(//|/\*|\*|#|<!--|--)"
#: A blank line or one that begins with a comment's mark; a text that begins with a comment.
_MARKED = r"^[ \t\r\f\x{FEFF}]*(" + _MARK + "|$)"
_BEGINS_MARKED = r"^[ \t\r\n\f\x{FEFF}]*" + _MARK


@dataclass(frozen=True)
class Layout:
    """Thresholds of one language.

    A file with lines that are long on average and at most, little white space and few letters and digits
    (short names leave room for marks; a long list of words doesn't) is minified. One with a large share
    of number literals, and ``least_numbers`` characters of them, or of long encoded runs is data. One
    whose names are short on average (few words, used over and over, by at least ``least_names`` names)
    beside many number literals, or that repeats its lines with little white space, is a tool's output.
    """

    mean_line: int = 150
    longest_line: int = 400
    spaces: float = 0.07
    letters_and_digits: float = 0.75
    numbers: float = 0.15
    least_numbers: int = 150
    encoded: float = 0.4
    mean_name: float = 7.0
    least_names: int = 150
    numbers_beside: float = 0.018
    repeated: float = 0.24
    least_filled: int = 25
    spaces_beside: float = 0.115


#: By extension; other extensions take the default, which is as strict as the strictest of them.
LAYOUTS = {
    "ts": Layout(mean_name=8.0),
    "tsx": Layout(mean_name=7.8),
    "js": Layout(mean_name=7.8),
    "jsx": Layout(mean_name=8.1),
    "mjs": Layout(mean_name=7.9),
    "cjs": Layout(mean_name=7.8),
    "css": Layout(mean_line=200, spaces=0.06, letters_and_digits=0.8, numbers=0.3, least_names=1 << 40, repeated=2.0),
    "html": Layout(mean_line=400, longest_line=2000, least_names=1 << 40, repeated=2.0),
    "py": Layout(spaces=0.1),
}
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"


def _lost(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def without_encoded(code: Column) -> Column:
    return F.regexp_replace(code, ENCODED_ONCE, "")


def head_of(code: Column) -> Column:
    """The first lines of a text, and all lines before its first line of code if these are more.

    A line is a comment if it begins with a comment's mark, is inside a block comment or is blank; what
    follows a block's end on its line isn't looked at.
    """

    def step(state: Column, line: Column) -> Column:
        close = state["close"]
        mark = F.ltrim(F.translate(line, "\t\r\f\ufeff", "    "))
        opened = F.when(mark.startswith("/*") & ~F.substring(mark, 3, 1 << 30).contains("*/"), "*/").when(mark.startswith("<!--") & ~F.substring(mark, 5, 1 << 30).contains("-->"), "-->").otherwise("")
        goes_on = (close != "") | line.rlike(_MARKED)
        after = F.when(close == "", opened).when(line.contains(close), "").otherwise(close)
        ended = state["ended"] | ~goes_on
        return F.struct(F.when(ended, state["lines"]).otherwise(state["lines"] + 1).alias("lines"), F.when(ended, close).otherwise(after).alias("close"), ended.alias("ended"))

    start = F.struct(F.lit(0).alias("lines"), F.lit("").alias("close"), F.lit(False).alias("ended"))
    leading = F.aggregate(F.split(code, "\n"), start, step, lambda s: s["lines"])
    longer = F.when(code.rlike(_BEGINS_MARKED), F.greatest(leading, F.lit(HEAD_LINES))).otherwise(F.lit(HEAD_LINES))
    return F.call_function("substring_index", code, F.lit("\n"), longer)


def chunk_layout(code: Column, bare: Column, head: Column) -> list[Column]:
    """The statistics of one piece of code that its file's are made of; all additive but the longest line.

    ``bare`` is the code without its long encoded runs, best as a column made before; ``head``, what is
    searched for notices, likewise.
    """
    filled = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    banner = sum((head.rlike(p).cast("int") for p in BANNER), F.lit(0))
    return [
        F.length(code).cast("long").alias("chars"),
        (F.length(code) - F.length(bare)).cast("long").alias("encoded"),
        (F.length(code) - F.length(F.replace(code, F.lit("\n"))) + 1).cast("long").alias("lines"),
        F.array_max(F.transform(F.split(bare, "\n"), F.length)).alias("longest"),
        _lost(bare, r"[ \t\r\n]+").alias("spaces"),
        _lost(bare, r"[A-Za-z0-9]+").alias("alnum"),
        _lost(bare, NUMBER).alias("numbers"),
        _lost(bare, _NAME).alias("name_chars"),
        F.regexp_count(bare, F.lit(_NAME)).cast("long").alias("names"),
        F.size(filled).cast("long").alias("filled"),
        F.size(F.array_distinct(filled)).cast("long").alias("different"),
        (head.rlike(TOOL) | head.rlike(COPY) | (banner >= 2)).alias("notice"),
    ]


def _beyond(extension: Column) -> Column:
    """Whether a file's sums are beyond its language's thresholds."""

    def rule(t: Layout) -> Column:
        bare = F.greatest(F.col("chars") - F.col("encoded"), F.lit(1))
        minified = (bare / F.col("lines") > t.mean_line) & (F.col("longest") > t.longest_line) & (F.col("spaces") / bare < t.spaces) & (F.col("alnum") / bare < t.letters_and_digits)
        numbers = (F.col("numbers") / bare > t.numbers) & (F.col("numbers") >= t.least_numbers)
        short = (F.col("name_chars") / F.greatest(F.col("names"), F.lit(1)) < t.mean_name) & (F.col("names") >= t.least_names) & (F.col("numbers") / bare > t.numbers_beside)
        again = (1 - F.col("different") / F.greatest(F.col("filled"), F.lit(1)) > t.repeated) & (F.col("filled") >= t.least_filled) & (F.col("spaces") / bare < t.spaces_beside)
        return minified | numbers | short | again | (F.col("encoded") / F.greatest(F.col("chars"), F.lit(1)) > t.encoded)

    found = rule(Layout())
    for name, layout in LAYOUTS.items():
        found = F.when(extension == name, rule(layout)).otherwise(found)
    return found


def decided_files(df: DataFrame, path: str = "file_path", code: str = "code", chunk: str = "id") -> DataFrame:
    """(path, by): the files of ``not_hand_written`` and whether their layout, path or notice decides, in that order."""
    p, c = F.col(f"`{path}`"), F.col(f"`{code}`")
    narrow = spread(df.where(p.isNotNull()).select(p.alias("path"), F.coalesce(F.col(f"`{chunk}`").cast("string"), F.lit("")).alias("chunk"), c.alias("code")))
    given = narrow.select("path", "chunk", "code", without_encoded(F.col("code")).alias("bare"), head_of(F.col("code")).alias("head"))
    rows = given.select("path", "chunk", *chunk_layout(F.col("code"), F.col("bare"), F.col("head")))
    sums = ("chars", "encoded", "lines", "spaces", "alnum", "numbers", "name_chars", "names", "filled", "different")
    each = rows.groupBy("path", "chunk").agg(*(F.max(x).alias(x) for x in (*sums, "longest", "notice")))
    files = each.groupBy("path").agg(*(F.sum(x).alias(x) for x in sums), F.max("longest").alias("longest"), F.max("notice").alias("notice"))
    slashed = F.translate("path", "\\", "/")
    extension = F.lower(F.regexp_extract(slashed, r"\.([^./]*)$", 1))
    by = F.when(_beyond(extension), "layout").when(slashed.rlike(FOLDER) | slashed.rlike(NAME), "path").when(F.col("notice"), "notice")
    return files.where(~extension.isin(*CONFIGURATION)).select(F.col("path").alias(path), by.alias("by")).where("by is not null")


def not_hand_written(df: DataFrame, path: str = "file_path", code: str = "code", chunk: str = "id") -> DataFrame:
    """The different paths of files made by a tool, minified or bundled, copied from elsewhere, or data.

    All chunks of a file count, each id once, however often its row comes. Null paths are left out; null
    and empty code only leaves the path to go by. Configuration files never count. Paths are compared
    with either slash. Other columns are never read; an empty table gives an empty result.
    """
    return decided_files(df, path, code, chunk).select(path)
