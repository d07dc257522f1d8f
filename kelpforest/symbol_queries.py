"""Symbols of source files in every grammar: files made of the documents, with definitions at known lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforest import queries as Q
from kelpforest.operators import chunking

#: By grammar: what stands around a document's text on the first line, the lines of a definition (``@N`` is the document's number, ``@K`` stands
#: for six lines and up to three more), its kind and name, and its first and last line without those more. Each hides a brace.
FILES = {
    "python": ("# ", "", ["@cache", "def f@N(a):", '    """{ no brace"""', "@K"], "function", "f@N", 2, 10),
    "typescript": ("// ", "", ["export function f@N(a: string): string {", "  const t = `${ a } {`;", "@K", "}"], "function", "f@N", 2, 10),
    "tsx": ("/* ", " */", ["export function f@N(a: Props) {", '  const t = <p title="{">{a}</p>;', "@K", "}"], "function", "f@N", 2, 10),
    "javascript": ("// ", "", ["async function f@N(a) {", "  const r = a.replace(/[{]/g, b / c);", "@K", "}"], "function", "f@N", 2, 10),
    "go": ("// ", "", ["func f@N(a string) string {", "  s := `{`", "@K", "}"], "function", "f@N", 2, 10),
    "rust": ("// ", "", ["pub fn f@N<'a>(x: &'a str) -> char {", "    let c = ('{', r#\"{ \" {\"#);", "@K", "}"], "function", "f@N", 2, 10),
    "java": ("// ", "", ["class C@N {", "  String f@N(int a) {", '    String t = """', '      { " {', '      """;', "@K", "  }", "}"], "method", "C@N.f@N", 3, 13),
    "csharp": ("// ", "", ["class C@N {", "  string f@N(int a) {", '    var s = @"{ ""\\";', "@K", "  }", "}"], "method", "C@N.f@N", 3, 11),
    "ruby": ("# ", "", ["def f@N(a)", "@K", "end"], "method", "f@N", 2, 9),
    "php": ("<?php // ", "", ["function f@N($a) {", "  # {", "  $t = <<<EOT", "  { $a {", "  EOT;", "@K", "}"], "function", "f@N", 2, 13),
    "c": ("// ", "", ["int f@N(char c) {", "    if (c == '{') return 1;", "@K", "}"], "function", "f@N", 2, 10),
    "cpp": ("// ", "", ["int f@N(char c) {", '    log("\\"{"); /* { */', "@K", "}"], "function", "f@N", 2, 10),
    "sql": ("-- ", "", ["CREATE FUNCTION f@N() RETURNS int AS $$", "@K", "$$ LANGUAGE sql;"], "function", "f@N", 2, 9),
    "bash": ("# ", "", ["f@N() {", "  cat <<EOF", "  { ${x", "EOF", "@K", "}"], "function", "f@N", 2, 12),
    "css": ("/* ", " */", [".f@N {", '  content: "{";', "@K", "}"], "rule", ".f@N", 2, 10),
    "scss": ("// ", "", ["@mixin f@N($a) {", "  // {", "@K", "}"], "mixin", "f@N", 2, 10),
    "html": ("<!-- ", " -->", ["<section>", "@K", "</section>"], "element", "section", 2, 9),
}
FILL = "    x = compute(y);\n"
_KINDS = ", ".join(f"({i}, '{g}', '{kind}', '{name}', {a}, {z})" for i, (g, (*_, kind, name, a, z)) in enumerate(FILES.items()))


@Q.query(
    f"""SELECT doc_id, g AS grammar, kind AS symbol_type, replace(name, '@N', doc_id::VARCHAR) AS symbol_name, a::INT AS start_line, (z + doc_id % 4)::INT AS end_line
FROM documents JOIN (VALUES {_KINDS}) AS t(i, g, kind, name, a, z) ON doc_id % {len(FILES)} = i"""
)
def symbol_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the definition of each document's file stands, in all grammars in turn."""
    pick = lambda part: F.element_at(F.array(*(F.lit(part(f)) for f in FILES.values())), (F.col("doc_id") % len(FILES) + 1).cast("int"))
    fill = F.concat(F.lit(FILL * 6), F.repeat(F.lit(FILL), (F.col("doc_id") % 4).cast("int")))
    body = F.replace(F.replace(pick(lambda f: "\n".join(f[2]) + "\n"), F.lit("@K\n"), fill), F.lit("@N"), F.col("doc_id").cast("string"))
    # On a line of its own, whatever counts as the end of one; a comment's end is taken out.
    line = F.regexp_replace("text", r"[\s\p{C}\x{2028}\x{2029}]+|\*/|-->", " ")
    grammar = F.element_at(F.array(*map(F.lit, FILES)), (F.col("doc_id") % len(FILES) + 1).cast("int"))
    files = Q.documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("key"), "doc_id", F.concat(pick(lambda f: f[0]), line, pick(lambda f: f[1]), F.lit("\n"), body).alias("text"), F.lit("code").alias("chunker"), grammar.alias("grammar")
    )
    found = chunking.chunk(files, ("doc_id", "grammar")).where("symbol_type IS NOT NULL AND symbol_type != 'module'")
    return found.select("doc_id", "grammar", "symbol_type", "symbol_name", "start_line", "end_line")
