"""Process-model documents (XML) to `processes`, `nodes` and `flows`.

Spark's XML functions read the elements; they ignore what the schema does not
name, so documents are also checked tag by tag with regular expressions, and
anything unknown is reported. Namespace prefixes are resolved by the root tag
only: a document that rebinds a prefix on an inner element is refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.operators.process_models import END, FLOW, GATEWAY, MAX_BYTES, NODE_KINDS, START, TASK

# Namespaces of the model and diagram standards, allowed attributes.
MODEL_NAMESPACE = "http://www.omg.org/spec/BPMN/20100524/MODEL"
DIAGRAM_NAMESPACE = "http://www.omg.org/spec/BPMN/20100524/DI"
PLAIN_ATTRIBUTES = {
    "process": ("id", "name", "isExecutable"),
    START: ("id", "name"),
    END: ("id", "name"),
    TASK: ("id", "name"),
    GATEWAY: ("id", "name"),
    FLOW: ("id", "name", "sourceRef", "targetRef"),
}
EXTENSION_ATTRIBUTES = {
    TASK: ("aisle", "alternative"),
    GATEWAY: ("variable",),
    FLOW: ("value",),
}

_NODE = (
    "array<struct<_id:string,_aisle:string,_alternative:string,_variable:string>>"
)
_FLOW = "array<struct<_id:string,_sourceRef:string,_targetRef:string,_value:string>>"
_DOCUMENT = (
    "process array<struct<_id:string,_isExecutable:string,"
    + ",".join(f"{kind}:{_NODE}" for kind in NODE_KINDS)
    + f",{FLOW}:{_FLOW}>>, _corrupt_record string"
)
# the same elements where they are only counted
_COUNTED = (
    "process array<struct<" + ",".join(f"{kind}:array<struct<_id:string>>" for kind in (*NODE_KINDS, FLOW)) + ">>, _corrupt_record string"
)

# one tag, with quoted attribute values that may hold `>`
# possessive quantifiers: a long tag is matched by a loop, not by recursion
_TAG = r"""<([A-Za-z_][\w.:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>"""
_MARKUP = r"""<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|\s++"""
_DECLARATION = r"\A<\?xml\b[^<>?]*+\?>"
_ATTRIBUTE = r"""([A-Za-z_][\w.:-]*+)\s*+=\s*+(?:"[^"]*+"|'[^']*+')"""


@dataclass(frozen=True)
class ModelTables:
    processes: DataFrame
    nodes: DataFrame
    flows: DataFrame
    document_violations: DataFrame
    elements: DataFrame


def read_process_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file (doc_id, n_bytes, xml). The content of oversize files is never read.

    The filter on `length` reaches the file source, which then skips their bytes.
    """
    files = spark.read.format("binaryFile").load(path)
    named = files.select(F.col("path").alias("doc_id"), F.col("length").alias("n_bytes"), "content")
    small = named.filter(F.col("n_bytes") <= MAX_BYTES).withColumn("xml", F.decode("content", "UTF-8"))
    large = named.filter(F.col("n_bytes") > MAX_BYTES).withColumn("xml", F.lit(None).cast("string"))
    columns = ("doc_id", "n_bytes", "xml")
    return small.select(*columns).unionByName(large.select(*columns))


def read_process_models(spark: SparkSession, path: str, extension_namespace: str) -> ModelTables:
    """Models of all XML files below `path`."""
    return parse_process_models(read_process_documents(spark, path), extension_namespace)


# what is left out of the checks: (text without which no pattern matches, patterns)
_LEFT_OUT = (
    ("<!--", (r"(?s)<!--.*?-->",)),
    ("<?", (r"(?s)<\?.*?\?>",)),
    *(
        (name, (rf"(?s)<([\w.-]+:)?{name}\b[^>]*?/>", rf"(?s)<(([\w.-]+:)?{name})\b.*?</\1\s*>"))
        for name in ("documentation", "BPMNDiagram")
    ),
)


def _stripped(rows: DataFrame, name: str) -> DataFrame:
    """Rows with the text `name` without comments, processing instructions, documentation and diagrams.

    One projection for each, so that a text is searched only for what it contains.
    """
    for part, patterns in _LEFT_OUT:
        text = F.col(name)
        for pattern in patterns:
            text = F.regexp_replace(text, pattern, "")
        rows = rows.withColumn(name, F.when(F.contains(name, F.lit(part)), text).otherwise(F.col(name)))
    return rows


def _plain_document(extension_namespace: str, prefixed: bool) -> str:
    """A pattern of stripped documents that no check but that of well-formed XML can refuse.

    One root bound to the namespaces, in it one process, in it empty elements with known attributes only; between
    tags there is nothing but space. Group 1 is the prefix of the elements, where they have one. A document
    that does not match may still be in order: the checks tell. All loops are possessive.
    """
    name, extension = r"[A-Za-z_][\w.-]*+", r"\2" if prefixed else r"\1"
    is_, value = r"\s*+=\s*+", """(?:"[^"<]*+"|'[^'<]*+')"""
    quoted = lambda text: rf"\Q{text.replace(r'\E', r'\E\\E\Q')}\E"
    bound_to = lambda namespace: rf"""{is_}(?:"{quoted(namespace)}"|'{quoted(namespace)}')"""
    root = rf"""\s++[A-Za-z_][\w.:-]*+{is_}(?:"[^"'<>]*+"|'[^"'<>]*+')"""

    def first_bound(namespace: str, as_: str) -> str:
        """The first attribute that binds a prefix to the namespace does so by this name."""
        bound = bound_to(namespace)
        return rf"(?=(?:(?!\s++xmlns[\w.:-]*+{bound}){root})*+\s++{as_}{bound})"

    prefix = r"\1:" if prefixed else ""

    def tag(kind: str) -> str:
        known = [*PLAIN_ATTRIBUTES[kind], *(f"{extension}:{a}" for a in EXTENSION_ATTRIBUTES.get(kind, ()))]
        return rf"{kind}(?:\s++(?:{'|'.join(known)}){is_}{value})*+\s*+"

    elements = "|".join(rf"{tag(kind)}(?:/>|>\s*+</{prefix}{kind}\s*+>)" for kind in PLAIN_ATTRIBUTES if kind != "process")
    return (
        rf"\A\s*+<{f'({name}):' if prefixed else ''}definitions"
        + first_bound(MODEL_NAMESPACE, r"xmlns:\1" if prefixed else "xmlns")
        + first_bound(extension_namespace, rf"xmlns:({name})")
        + rf"(?:{root})*+\s*+>\s*+<{prefix}{tag('process')}>\s*+(?:<{prefix}(?:{elements})\s*+)*+"
        + rf"</{prefix}process\s*+>\s*+</{prefix}definitions\s*+>\s*+\z"
    )


def _tags(body: Column) -> Column:
    """Opening tags as (name, text of the attributes)."""
    names = F.regexp_extract_all(body, F.lit(_TAG), F.lit(1))
    texts = F.regexp_extract_all(body, F.lit(_TAG), F.lit(2))
    return F.arrays_zip(names.alias("name"), texts.alias("text"))


def _tag_forms(tags: Column) -> Column:
    """Different tags as (name, local, attributes), the name without prefix and the names of attributes; values do not count.

    Names have no spaces, so a tag is one text while copies are left out.
    """
    told = F.transform(tags, lambda t: F.concat_ws(
        " ", t["name"], F.regexp_extract_all(t["text"], F.lit(_ATTRIBUTE), F.lit(1))))
    parts = F.transform(F.array_distinct(told), lambda s: F.split(s, " "))
    return F.transform(parts, lambda p: F.struct(
        p[0].alias("name"), F.substring_index(p[0], ":", -1).alias("local"), F.slice(p, 2, F.size(p)).alias("attributes"),
    ))


def _prefix(root: Column, namespace: str | Column) -> Column:
    """Prefix (with its colon) the root tag binds to a namespace; empty for the default, else null."""
    uri = F.lit(namespace) if isinstance(namespace, str) else namespace
    names = F.regexp_extract_all(root, F.lit(_ATTRIBUTE), F.lit(1))
    values = F.regexp_extract_all(
        root, F.lit(r"""[A-Za-z_][\w.:-]*\s*=\s*["']([^"']*)["']"""), F.lit(1)
    )
    bound = F.filter(
        F.arrays_zip(names.alias("n"), values.alias("v")),
        lambda x: (x["v"] == uri) & (F.startswith(x["n"], F.lit("xmlns"))),
    )
    # told inside the array, which is made once
    prefix = lambda x: F.when(x["n"] == "xmlns", "").otherwise(
        F.concat(F.regexp_replace(x["n"], "^xmlns:", ""), F.lit(":"))
    )
    return F.get(F.transform(F.slice(bound, 1, 1), prefix), F.lit(0))


def _unknown_attributes(tag: Column, extension: Column) -> Column:
    """Attribute names a tag must not carry."""
    names, local = tag["attributes"], tag["local"]
    allowed = F.array().cast("array<string>")
    for kind, plain in PLAIN_ATTRIBUTES.items():
        own = F.array(*[F.lit(a) for a in plain])
        extended = F.array(
            *[F.concat(extension, F.lit(a)) for a in EXTENSION_ATTRIBUTES.get(kind, ())]
        ).cast("array<string>")
        usable = F.when(extension.isNull() | (extension == ""), own).otherwise(
            F.concat(own, extended)
        )
        allowed = F.when(local == kind, usable).otherwise(allowed)
    repeated = F.size(names) != F.size(F.array_distinct(names))
    return F.when(repeated, F.array(F.lit("repeated"))).otherwise(F.array_except(names, allowed))


def parse_process_models(documents: DataFrame, extension_namespace: str) -> ModelTables:
    """Models of `documents(doc_id, xml)`; `n_bytes` is taken from the text when absent.

    `extension_namespace` is the namespace of the aisle, alternative, variable
    and value attributes.
    """
    if "n_bytes" not in documents.columns:
        documents = documents.withColumn("n_bytes", F.octet_length("xml").cast("long"))
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
    parsed = documents.withColumn(
        "_doc", F.from_xml(F.when(F.col("n_bytes") <= MAX_BYTES, F.col("xml")), _DOCUMENT, options)
    )
    found = parsed.select("doc_id", "n_bytes", F.explode("_doc.process").alias("_p")).select(
        "doc_id", "n_bytes", F.coalesce("_p._id", F.lit("")).alias("process_id"), "_p"
    )
    processes = found.select(
        "doc_id", "process_id", F.col("_p._isExecutable").alias("is_executable"), "n_bytes"
    )
    text = lambda c: F.coalesce(c, F.lit(""))

    def typed(kind: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"_p.{kind}"), F.array().cast(_NODE)),
            lambda n: F.struct(
                text(n["_id"]).alias("id"),
                F.lit(kind).alias("kind"),
                text(n["_aisle"]).alias("aisle"),
                text(n["_alternative"]).alias("alternative"),
                text(n["_variable"]).alias("variable"),
            ),
        )

    listed = F.concat(*[typed(kind) for kind in NODE_KINDS])
    nodes = found.select("process_id", F.explode(listed).alias("_n")).select("process_id", "_n.*")
    flows = found.select("process_id", F.explode(f"_p.{FLOW}").alias("_f")).select(
        "process_id",
        text(F.col("_f._id")).alias("id"),
        text(F.col("_f._sourceRef")).alias("source"),
        text(F.col("_f._targetRef")).alias("target"),
        text(F.col("_f._value")).alias("value"),
    )
    # nodes and flows as one table: each document is parsed once, not once for either
    blank = lambda *names: [F.lit("").alias(n) for n in names]
    of_node = ("id", "kind", "aisle", "alternative", "variable")
    as_node = lambda n: F.struct(*[n[c].alias(c) for c in of_node], *blank("source", "target", "value"))
    as_flow = lambda f: F.struct(
        text(f["_id"]).alias("id"), F.lit(FLOW).alias("kind"), *blank("aisle", "alternative", "variable"),
        text(f["_sourceRef"]).alias("source"), text(f["_targetRef"]).alias("target"), text(f["_value"]).alias("value"),
    )
    both = F.concat(
        F.transform(listed, as_node), F.transform(F.coalesce(F.col(f"_p.{FLOW}"), F.array().cast(_FLOW)), as_flow)
    )
    elements = found.select("process_id", F.explode(both).alias("_e")).select("process_id", "_e.*")
    return ModelTables(processes, nodes, flows, _document_violations(documents, extension_namespace, options), elements)


def _seen_elements() -> Column:
    """Number of named elements of every process of `_doc`, as read by the element schema."""
    per_process = lambda p: reduce(
        lambda total, kind: total + F.coalesce(F.array_size(p[kind]), F.lit(0)), [*NODE_KINDS, FLOW], F.lit(0)
    )
    return F.aggregate(
        F.coalesce(F.transform("_doc.process", per_process), F.array().cast("array<int>")),
        F.lit(0),
        lambda a, b: a + b,
    )


def _doubtful_documents(documents: DataFrame, extension_namespace: str, options: dict[str, str]) -> DataFrame:
    """Documents that are not told to be in order by `_plain_document`, with `_body`, their stripped text, and `_doc`, their
    elements as far as they are counted.

    A plain document has to be well-formed. Where nothing but an XML declaration was stripped, nothing is made of its
    elements; else their number tells whether the parser reads the same elements as the pattern.
    """
    within, kept = F.col("n_bytes") <= MAX_BYTES, ("doc_id", "n_bytes", "xml")
    text = F.when(F.col("n_bytes") > MAX_BYTES, "").otherwise(F.coalesce("xml", F.lit("")))
    rows = _stripped(documents.select(*kept, text.alias("_body")), "_body")
    plain = reduce(Column.__or__, [F.col("_body").rlike(_plain_document(extension_namespace, p)) for p in (True, False)])
    rows = rows.withColumn("_plain", F.coalesce(within & plain, F.lit(False)))
    bare = F.col("_plain") & (F.col("_body") == F.regexp_replace("xml", _DECLARATION, ""))
    rows = rows.withColumn("_bare", F.coalesce(bare, F.lit(False)))
    broken = F.from_xml(F.when(F.col("_bare"), F.col("xml")), "_corrupt_record string", options)["_corrupt_record"].isNotNull()
    # a generator, unlike a filter, is not taken below the projections that strip the text
    left = lambda in_order, *names: rows.select(
        *kept, *names, F.explode(F.when(~in_order, F.array("_body"))).alias("_body"))
    rows = left(F.col("_bare") & ~broken, "_plain")
    rows = rows.withColumn("_doc", F.from_xml(F.when(within, F.col("xml")), _COUNTED, options))
    # all tags of a plain document but the root and the process are elements
    counted = F.regexp_count("_body", F.lit("<[A-Za-z_]")) - 2 == _seen_elements()
    return left(F.col("_plain") & F.col("_doc._corrupt_record").isNull() & counted, "_doc")


def _document_violations(documents: DataFrame, extension_namespace: str, options: dict[str, str]) -> DataFrame:
    """(doc_id, rule, subject) for everything the element schema cannot see."""
    kinds = [*NODE_KINDS, FLOW]
    known = ["definitions", "process", *kinds]
    rows = _doubtful_documents(documents, extension_namespace, options)
    rows = rows.withColumn("_tags", _tags(F.col("_body")))
    rows = rows.withColumn("_forms", _tag_forms(F.col("_tags")))
    rows = rows.withColumn("_names", F.transform("_tags", lambda t: F.substring_index(t["name"], ":", -1)))
    root = F.get("_tags", F.lit(0))["text"]
    rows = rows.withColumn("_model", _prefix(root, MODEL_NAMESPACE))
    rows = rows.withColumn("_ext", _prefix(root, extension_namespace))
    local = lambda t: t["local"]

    names = F.col("_names")
    foreign = F.filter(
        "_forms",
        lambda t: (t["name"] != F.concat(F.coalesce(F.col("_model"), F.lit("?")), local(t)))
        | ~local(t).isin(*known),
    )
    inner = F.filter("_forms", lambda t: local(t).isin("process", *kinds))
    unknown = F.flatten(
        F.transform(
            inner,
            lambda t: F.transform(
                _unknown_attributes(t, F.col("_ext")),
                lambda a: F.concat(local(t), F.lit("@"), a),
            ),
        )
    )
    n_kind = F.size(F.filter(names, lambda n: n.isin(*kinds)))
    count_of = lambda name: F.size(F.filter(names, lambda n: n == name))
    stray_text = F.length(F.trim(F.regexp_replace("_body", _MARKUP, ""))) > 0
    oversize = F.col("n_bytes") > MAX_BYTES
    one = lambda rule, subject="": F.array(
        F.struct(F.lit(rule).alias("rule"), F.lit(subject).alias("subject"))
    )
    named = lambda rule, items: F.transform(
        items, lambda s: F.struct(F.lit(rule).alias("rule"), s.alias("subject"))
    )
    empty = F.slice(one(""), 1, 0)
    only_if = lambda cond, entries: F.when(cond, entries).otherwise(empty)
    checks = F.concat(
        only_if(F.col("_doc._corrupt_record").isNotNull(), one("malformed_xml")),
        only_if(F.col("_body").contains("<!"), one("doctype")),
        only_if(stray_text, one("text")),
        only_if(
            (count_of("definitions") != 1)
            | (F.coalesce(F.get(names, F.lit(0)), F.lit("")) != "definitions"),
            one("one_root"),
        ),
        only_if(count_of("process") != 1, one("one_process")),
        only_if(F.col("_model").isNull(), one("namespace")),
        only_if(
            F.col("_doc._corrupt_record").isNull() & (n_kind != _seen_elements()),
            one("nested_element"),
        ),
        named("unknown_element", F.array_distinct(F.transform(foreign, lambda t: t["name"]))),
        named("unknown_attribute", F.array_distinct(unknown)),
    )
    verdict = F.when(oversize, one("oversize")).otherwise(checks)
    return rows.select("doc_id", F.explode(verdict).alias("_v")).select("doc_id", "_v.*")
