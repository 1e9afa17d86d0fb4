"""Path rules: text detection, settings classes, file keys, conflict-copy names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions that are treated as text.
TEXT_EXTENSIONS = (
    ".md .txt .json .canvas .csv .tsv .xml .html .htm .css .js .ts .yaml .yml .toml .ini .cfg "
    ".conf .log .sh .bash .zsh .py .rb .rs .go .java .kt .swift .dart .c .h .cpp .hpp .tex .bib "
    ".org .rst .adoc .svg .fountain .fdx .lua .r .scala .php .pl .markdown .mdx .qmd .tsx .jsx "
    ".vue .sql .gql .graphql .proto .lock .gitignore .env .makefile .dockerfile"
).split()


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for none, a leading or a trailing dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def classify_text(path: str | Column) -> Column:
    col = F.col(path) if isinstance(path, str) else path
    ext = extension(col)
    return (ext == "") | ext.isin(*TEXT_EXTENSIONS)


def is_hidden(path: str | Column) -> Column:
    col = F.col(path) if isinstance(path, str) else path
    return F.exists(F.split(col, "/"), lambda s: s.startswith("."))


def classify_setting(path: str | Column, config_dir: str = ".obsidian",
                     self_plugin: str = "sync-plugin") -> Column:
    """``struct<kind, category>`` of a settings path, null when it is never synced."""
    raw = F.col(path) if isinstance(path, str) else path
    norm = F.replace(raw, F.lit("\\"), F.lit("/"))
    prefix = config_dir + "/"
    rel = F.when(norm.startswith(prefix), F.substring(norm, len(prefix) + 1, 1 << 20)).otherwise(norm)
    seg = F.split(rel, "/")
    n = F.size(seg)
    head, second, last = seg[0], F.get(seg, F.lit(1)), F.element_at(seg, -1)

    def cls(kind: str, category: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(category).alias("category"))

    banned = ((rel == "") | rel.contains("..")
              | rel.isin("workspace.json", "workspace-mobile.json")
              | ((head == "plugins") & (n >= 2) & (second == self_plugin))
              | rel.rlike(r"\.(db|log|sqlite|sqlite-journal)$"))
    return (F.when(F.coalesce(banned, F.lit(True)), F.lit(None))
            .when(rel.isin("app.json", "graph.json"), cls("fieldMap", "appSettings"))
            .when(rel == "appearance.json", cls("fieldMap", "appearance"))
            .when(rel == "hotkeys.json", cls("fieldMap", "hotkeys"))
            .when(rel == "core-plugins.json", cls("fieldMap", "corePluginsEnabled"))
            .when(rel == "community-plugins.json", cls("orSet", "communityPluginsEnabled"))
            .when((head == "plugins") & (n >= 3) & (last == "data.json"),
                  cls("wholeFile", "communityPluginSettings"))
            .when((head == "plugins") & (n >= 3), F.lit(None))
            .when((head == "themes") & (n >= 2), cls("wholeFile", "themesSnippets"))
            .when((head == "snippets") & rel.endswith(".css"), cls("wholeFile", "themesSnippets"))
            .when((n == 1) & rel.endswith(".json"), cls("fieldMap", "corePluginSettings")))


# The categories a device can enable.
CATEGORIES = ("appSettings", "appearance", "hotkeys", "corePluginsEnabled", "corePluginSettings",
              "communityPluginsEnabled", "communityPluginSettings", "themesSnippets")


def selective(df: DataFrame, enabled: list[str], category: str = "category") -> DataFrame:
    """Rows of enabled categories; names outside the known list are ignored."""
    return df.where(F.col(category).isin(*[c for c in enabled if c in CATEGORIES] or [""]))


def file_id(namespace: str | uuid.UUID, path: str | Column) -> Column:
    """UUIDv5 of a path under a vault's UUID, in native expressions."""
    col = F.col(path) if isinstance(path, str) else path
    ns = uuid.UUID(str(namespace)).hex
    digest = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(col, "UTF-8")))
    return _uuid5(digest)


def file_id_for(vault_uuid: str | Column, path: str | Column) -> Column:
    """UUIDv5 where each row names its own vault UUID."""
    v = F.col(vault_uuid) if isinstance(vault_uuid, str) else vault_uuid
    col = F.col(path) if isinstance(path, str) else path
    digest = F.sha1(F.concat(F.unhex(F.replace(v, F.lit("-"), F.lit(""))), F.encode(col, "UTF-8")))
    return _uuid5(digest)


def _uuid5(digest: Column) -> Column:
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def conflict_copy_path(path: str | Column, ms: str | Column, node: str | Column) -> Column:
    """``stem (conflict <UTC stamp> from <node>).ext``; a dot at index 0 is no extension."""
    p = F.col(path) if isinstance(path, str) else path
    m = F.col(ms) if isinstance(ms, str) else ms
    nd = F.col(node) if isinstance(node, str) else node
    mark = F.concat(F.lit(" (conflict "),
                    F.date_format(F.timestamp_millis(m), "yyyy-MM-dd'T'HHmmss"),
                    F.lit(" from "), nd, F.lit(")"))
    split_at = r"(?s)^(.+)(\.[^.]*)$"
    return F.when(p.rlike(split_at), F.concat(F.regexp_extract(p, split_at, 1), mark,
                                              F.regexp_extract(p, split_at, 2))
                  ).otherwise(F.concat(p, mark))
