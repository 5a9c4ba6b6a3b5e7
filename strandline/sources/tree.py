"""Source trees as tables: files with language, hash and lines, and the lines themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions and whole names by language.
EXTENSIONS = {
    "typescript": "ts mts cts tsx", "javascript": "js mjs cjs jsx", "vue": "vue", "python": "py pyi", "java": "java", "csharp": "cs", "go": "go", "rust": "rs", "ruby": "rb", "php": "php",
    "c": "c h", "cpp": "cc cpp cxx hpp hh", "kotlin": "kt kts", "bash": "sh bash", "scala": "scala sc", "lua": "lua", "elixir": "ex exs", "dart": "dart", "haskell": "hs", "clojure": "clj cljs cljc",
    "swift": "swift", "r": "r", "julia": "jl", "zig": "zig", "ocaml": "ml mli", "terraform": "tf tfvars hcl", "yaml": "yaml yml", "turtle": "ttl", "markdown": "md", "json": "json",
}
NAMES = {"dockerfile": "dockerfile", "gemfile": "ruby", "rakefile": "ruby"}
#: Folders that are never read, and the size from which generated files are left out.
IGNORED = (".git", "node_modules", "vendor", "dist", "build", "target", ".venv", "venv", "__pycache__", ".terraform", ".idea", ".vscode", "coverage")
GENERATED_BYTES = 512 * 1024
#: Files at the root of a tree that name what is not read.
IGNORE_FILES = (".gitignore", ".strandlineignore")


def language(path: Column, head: Column) -> Column:
    """By name, then extension, then the interpreter of a first line ``#!``."""
    low = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.when(low.rlike(r"^dockerfile(\..*)?$|\.dockerfile$"), "dockerfile")
    for name, lang in NAMES.items():
        out = out.when(low == name, lang)
    extension = F.regexp_extract(low, r"\.([a-z0-9]+)$", 1)
    for lang, words in EXTENSIONS.items():
        out = out.when(extension.isin(*words.split()), lang)
    return out.when(head.rlike(r"^#!.*\b(ba|z|k|da)?sh\b"), "bash").when(head.rlike(r"^#!.*\bpython"), "python").when(head.rlike(r"^#!.*\bnode"), "javascript").otherwise("")


def ignored(path: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Whether a path lies in an ignored folder or meets one of ``patterns`` (``*`` within a folder, ``**`` across, a final ``/`` for folders, ``!`` to take back)."""
    out = F.concat(F.lit("/"), path).rlike("/(?:" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/")
    for raw in patterns:
        back, body = raw.startswith("!"), raw.lstrip("!")
        anchored = "/" in body.rstrip("/")
        regex = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, x if x.isalnum() or x in "/_-" else "\\" + x) for x in _glob(body.strip("/")))
        hit = path.rlike(("^" if anchored else "(^|/)") + regex + ("/" if body.endswith("/") else "(/|$)"))
        out = (out & ~hit) if back else (out | hit)
    return out


def _glob(text: str) -> list[str]:
    out, i = [], 0
    while i < len(text):
        step = 2 if text.startswith("**", i) else 1
        out.append(text[i : i + step])
        i += step
    return out


def generated(path: Column, size: Column) -> Column:
    """Large minified, lock and generated files, and parser headers of any size."""
    low = F.lower(path)
    name = low.rlike(r"\.min\.(js|css)$|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|go\.sum)$|(^|/)generated/|\.generated\.")
    return ((size >= GENERATED_BYTES) & name) | low.rlike(r"(^|/)tree_sitter/parser\.h$")


def ignore_patterns(spark: SparkSession, root: str, names: tuple[str, ...] = IGNORE_FILES) -> tuple[str, ...]:
    """The patterns in the ignore files at ``root``, in any store; comments and lines that take back (``!``) are left out.

    Spark's own readers pass over names that begin with a dot, so these small files are read through the file system.
    """
    jvm, out = spark.sparkContext._jvm, []
    for name in names:
        at = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/" + name)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if store.exists(at):
            stream = store.open(at)
            try:
                text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            finally:
                stream.close()
            out += [x.strip() for x in text.split("\n")]
    return tuple(x for x in out if x.strip("/") and not x.startswith(("#", "!")))


def read_tree(spark: SparkSession, root: str, patterns: tuple[str, ...] = (), ignore_files: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """(path, language, sha256, line_count, content) of the files under ``root`` that neither its ignore files nor ``patterns`` name.

    Sizes are checked before contents are read; files and folders whose names begin with a dot or ``_`` are never read.
    """
    patterns = (*ignore_patterns(spark, root, ignore_files), *patterns)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://", 1)[-1].split(":", 1)[-1]
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", ""), "^/*" + "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in base.lstrip("/")) + "/", "")
    files = raw.select(path.alias("path"), "length", "content").filter(~ignored(F.col("path"), patterns) & ~generated(F.col("path"), F.col("length")))
    text = F.decode(F.col("content"), "UTF-8")
    head = F.substring_index(text, "\n", 1)
    lines = F.size(F.split(text, "\n")) - F.when(text.endswith("\n") | (text == ""), 1).otherwise(0)
    found = files.select("path", language(F.col("path"), head).alias("language"), F.sha2("content", 256).alias("sha256"), lines.cast("int").alias("line_count"), text.alias("content"))
    return found.filter("language <> ''")


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text)."""
    return files.select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def stale(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): files whose hash differs from the indexed one, are gone, or are new."""
    a, b = indexed.select("path", F.col("sha256").alias("old")), current.select("path", F.col("sha256").alias("new"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")
