"""Files of a directory tree as documents: what is worth reading, its language, and Python code as a graph."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.vectorised import arrow_udf

SKIPPED_DIRS = tuple(sorted("__pycache__ build coverage dist logs node_modules out target tmp vendor venv".split()))
SKIPPED_FILES = r"(?i)(^(bun\.lock|package-lock\.json$|pnpm-lock|yarn\.lock$)|\.(lock|map|snap)$|\.min\.(css|js)$|\.(7z|avi|bin|bz2|class|db|dylib|eot|exe|gif|gz|ico|jar|jpe?g|mov|mp3|mp4|onnx|otf|pdf|png|pyc|so|sqlite|svg|tgz|ttf|wasm|wav|webp|woff2?|zip)$)"
PROSE = {"adoc": "text", "md": "markdown", "mdx": "markdown", "rst": "text", "txt": "text"}
CODE = dict(x.split("=") for x in "c=c cc=cpp cpp=cpp cs=c_sharp css=css dart=dart ex=elixir go=go h=c hpp=cpp html=html java=java js=javascript json=json jsx=javascript kt=kotlin lua=lua php=php py=python rb=ruby rs=rust scala=scala sh=bash sol=solidity sql=sql swift=swift toml=toml ts=typescript tsx=tsx vue=vue yaml=yaml yml=yaml zig=zig".split())


def language(name):
    """markdown, text or a programming language, else null."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in (PROSE | CODE).items() for x in kv])
    return F.when(~name.rlike(SKIPPED_FILES), F.try_element_at(table, ext))


def read_tree(spark: SparkSession, root: str, max_bytes: int = 200_000, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(path, language, text) of readable files in order of paths, and counts of skipped files by reason."""
    from quillgraph.functions.text import is_binary

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/?", "")
    dirs = F.slice(F.split("rel", "/"), 1, F.greatest(F.lit(0), F.size(F.split("rel", "/")) - 1))
    f = files.select(path.alias("rel"), "length", "content").withColumn("language", language(F.element_at(F.split("rel", "/"), -1)))
    hidden = F.exists(dirs, lambda d: d.isin(*SKIPPED_DIRS) | F.startswith(d, F.lit(".")))
    why = F.when(hidden, "directory").when(F.col("language").isNull(), "other").when((F.col("length") > max_bytes) | (F.col("length") == 0), "size").when(is_binary(F.col("content")), "binary")
    judged = f.withColumn("why", why)
    kept = judged.where("why is null").orderBy("rel").limit(most)
    return kept.select(F.col("rel").alias("path"), "language", F.decode("content", "utf-8").alias("text")), judged.where("why is not null").groupBy("why").agg(F.count("*").alias("n"))


def code_graph(source: str | None, name: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str, float]]]:
    """Entities (id, label, type) and relations (from, to, type, confidence) of a Python module."""
    own = f"file:{name}"
    entities = {own: (own, name, "FILE")}
    relations: dict[tuple[str, str, str], float] = {}
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return list(entities.values()), []

    def symbol(label: str, kind: str) -> str:
        key = f"sym:{name}#{label}"
        entities[key] = (key, label, kind)
        return key

    defined: dict[str, str] = {}
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            c = defined[node.name] = symbol(node.name, "CLASS")
            relations[own, c, "defines"] = 1.0
            for m in node.body:
                if isinstance(m, functions):
                    relations[c, symbol(f"{node.name}.{m.name}", "METHOD"), "has_method"] = 1.0
        elif isinstance(node, functions):
            defined[node.name] = symbol(node.name, "FUNCTION")
            relations[own, defined[node.name], "defines"] = 1.0
    for node in ast.walk(tree):
        modules = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module] if isinstance(node, ast.ImportFrom) and node.module else []
        for m in modules:
            entities[f"module:{m}"] = (f"module:{m}", m, "MODULE")
            relations[own, f"module:{m}", "imports"] = 1.0
    scopes = [(defined[n.name], n) for n in tree.body if isinstance(n, functions)]
    scopes += [(f"sym:{name}#{c.name}.{m.name}", m) for c in tree.body if isinstance(c, ast.ClassDef) for m in c.body if isinstance(m, functions)]
    for caller, body in scopes:
        for call in (n for n in ast.walk(body) if isinstance(n, ast.Call)):
            called = call.func.id if isinstance(call.func, ast.Name) else None
            if called in defined and defined[called] != caller:
                relations[caller, defined[called], "calls"] = 0.7
    return list(entities.values()), [(*k, v) for k, v in relations.items()]


KIND = "entities array<struct<id:string,label:string,type:string>>, relations array<struct<from:string,to:string,type:string,confidence:double>>"


@arrow_udf(KIND)
def python_graph(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
    rows = [code_graph(t, n) for t, n in zip(texts, names)]
    return pd.DataFrame({"entities": [[dict(zip(("id", "label", "type"), e)) for e in es] for es, _ in rows], "relations": [[dict(zip(("from", "to", "type", "confidence"), r)) for r in rs] for _, rs in rows]})
