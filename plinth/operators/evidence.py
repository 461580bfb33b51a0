"""Evidence grades; no operator makes weak evidence strong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_hex64, last_component
from .integrity import difference, require

PROOF_CORPUS = "PROOF_CORPUS"
#: What a corpus may declare itself to be.
CORPUS_CLASSES = [PROOF_CORPUS, "PARTIAL_PROOF_CORPUS", "STATEMENT_CORPUS", "BENCHMARK_CORPUS"]
UNKNOWN_PROOF, NOT_PROOF, CANDIDATE_PROOF = "UNKNOWN_NOT_PROOF_EVIDENCE", "NOT_PROOF_EVIDENCE", "CANDIDATE_FOR_PROOF_VERIFICATION"
UNFINISHED = "sorryAx"
MOST_EVIDENCE, MOST_OUTPUT = 64 << 10, 1 << 20
SIDECAR = "plinth.proof-evidence-sidecar.v1"


def eligibility(corpus_class: Column, observed: Column, allowed: Column) -> Column:
    """Whether a declaration may enter further review; null class or axioms stay unknown."""
    unfinished = F.exists(observed, lambda a: last_component(a) == UNFINISHED)
    return (
        F.when(corpus_class.isNull() | observed.isNull(), UNKNOWN_PROOF)
        .when(corpus_class != PROOF_CORPUS, NOT_PROOF)
        .when(unfinished | (F.size(F.array_except(observed, allowed)) > 0), NOT_PROOF)
        .otherwise(CANDIDATE_PROOF)
    )


def eligible(corpus_class: str | None, observed: list[str] | None, allowed: list[str] | None = None) -> str:
    """:func:`eligibility` of one declaration."""
    if corpus_class is not None and corpus_class not in CORPUS_CLASSES:
        raise ValueError(f"unknown corpus class {corpus_class}")
    if any(not isinstance(a, str) or not a for a in [*(observed or []), *(allowed or [])]):
        raise ValueError("axioms must be texts")
    if corpus_class is None or observed is None:
        return UNKNOWN_PROOF
    sound = corpus_class == PROOF_CORPUS and not any(a.rsplit(".", 1)[-1] == UNFINISHED for a in observed) and set(observed) <= set(allowed or [])
    return CANDIDATE_PROOF if sound else NOT_PROOF


def replay_claim(declared: Column, claimed: Column, has_class: Column) -> Column:
    """Eligibility of a replay by the class it declares; a claim beyond that raises.

    A replay carries no axiom report, so a proof corpus stays unknown, and a replay without a
    class may claim nothing else.
    """
    fail = lambda what: F.raise_error(F.lit(what)).cast("string")
    allowed = F.when(declared == PROOF_CORPUS, UNKNOWN_PROOF).otherwise(NOT_PROOF)
    return (
        F.when(declared.isNull() & (has_class | (claimed.isNotNull() & (claimed != UNKNOWN_PROOF))), fail("incomplete replay evidence claim"))
        .when(declared.isNull(), UNKNOWN_PROOF)
        .when(~declared.isin(CORPUS_CLASSES), fail("unsupported corpus class"))
        .when(~claimed.eqNullSafe(allowed), fail("the replay claims more than its class allows"))
        .otherwise(allowed)
    )


def replay_evidence(replay: dict) -> dict[str, str | None]:
    """:func:`replay_claim` of one replay document."""
    declared, claimed = replay.get("corpus_class"), replay.get("proof_evidence")
    if declared is None:
        if "corpus_class" in replay or claimed not in (None, UNKNOWN_PROOF) or ("proof_evidence" in replay and claimed is None):
            raise ValueError("incomplete replay evidence claim")
        return {"declared_corpus_class": None, "proof_eligibility": UNKNOWN_PROOF}
    allowed = eligible(declared, None if declared == PROOF_CORPUS else [])
    if claimed != allowed:
        raise ValueError("the replay claims more than its class allows")
    return {"declared_corpus_class": declared, "proof_eligibility": allowed}


# ---------------------------------------------------------------- axiom reports


def report_details(line: Column, declaration: Column) -> Column:
    """What a report line says of a declaration; null if it is no report of it."""
    start = F.concat(F.lit("'"), declaration, F.lit("' "))
    return F.when(F.startswith(line, start), F.substring(line, F.length(start) + 1, F.length(line)))


def report_axioms(details: Column) -> Column:
    """The axioms that the details list; null if they are malformed or repeat a name."""
    listed = F.regexp_extract(details, r"^depends on axioms: \[(.*)\]$", 1)
    names = F.split(listed, ", ")
    good = (listed != "") & (F.size(F.array_distinct(names)) == F.size(names)) & ~F.exists(names, lambda n: (n == "") | (F.trim(n) != n))
    return F.when(details == "does not depend on any axioms", F.array().cast("array<string>")).when(good, names)


def axiom_reports(lines: DataFrame, declarations: DataFrame) -> DataFrame:
    """declaration, axioms, n_lines of tool output lines (column line).

    The name ends with the quote before one of the two sentences that a report may be, as
    names may hold quotes themselves; so it is the key of an equi-join.
    """
    name = F.regexp_extract("line", r"^'(.+)' (?:depends on axioms: \[.*\]|does not depend on any axioms)$", 1)
    named = lines.withColumn("declaration", name).where("declaration != ''")
    axioms = report_axioms(report_details(F.col("line"), F.col("declaration")))
    per = named.withColumn("axioms", axioms).groupBy("declaration").agg(F.min("axioms").alias("axioms"), F.count("*").alias("n_lines"))
    return declarations.select("declaration").distinct().join(per, "declaration", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


#: Codes of outputs and evidence that may not be read on.
EXECUTION, UNPINNED, MISMATCH = "LEAN_EXECUTION_FAILED", "UNPINNED_STDOUT", "LEAN_STDOUT_DIGEST_MISMATCH"
INCOMPLETE, UNPINNED_SIDECAR, SIDECAR_MISMATCH, TOO_LARGE = "INCOMPLETE_EVIDENCE", "UNPINNED_EVIDENCE", "SIDECAR_DIGEST_MISMATCH", "EVIDENCE_TOO_LARGE"
_SORRY = r"^.+:[0-9]+:[0-9]+: warning: declaration uses `sorry`$"
_REPORT = r"(?s)^'(.+)' ((?:depends on axioms: \[.*\]|does not depend on any axioms))$"


def _broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule of each rule (name: what breaks it) that a row breaks; an unknown breaks it."""
    marks = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))
    return rows.select(key, F.explode(marks).alias("rule"))


def output_lines(outputs: DataFrame) -> DataFrame:
    """output_id, place, line, declaration, axioms of outputs (output_id, content binary).

    ``declaration`` is null where the line is no report, ``axioms`` where the report is
    malformed.  Known warnings have the declaration null and ``warning`` true.
    """
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), r"\n\z", "")
    lines = outputs.select("output_id", F.posexplode(F.split(text, "\n")).alias("place", "line"))
    name, details = (F.regexp_extract("line", _REPORT, k) for k in (1, 2))
    told = lines.withColumn("warning", F.col("line").rlike(_SORRY)).withColumn("declaration", F.when(~F.col("warning") & (name != ""), name))
    return told.withColumn("axioms", F.when(F.col("declaration").isNotNull(), report_axioms(details)))


def report_violations(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """output_id, rule, key of whatever keeps outputs from being exact reports.

    ``outputs``: output_id, content, exit_code, expected_sha256.  ``expected``: output_id,
    declaration.  An output is sound if its run ended well, it is what was pinned, and its lines
    are one well-formed report of each expected declaration and known warnings that a report
    explains.  Any number of outputs are checked at once, by keys; an output of more than 1 MB is
    only told to be too long.
    """
    content, size = F.col("content"), F.octet_length("content")
    of_output = _broken(outputs, "output_id", {
        EXECUTION: F.col("exit_code") != 0,
        UNPINNED: ~is_hex64(F.col("expected_sha256")),
        MISMATCH: F.sha2(content, 256) != F.col("expected_sha256"),
        "output is empty or too long": (size < 1) | (size > MOST_OUTPUT),
        "output is no text of whole lines": ~F.is_valid_utf8(content.cast("string")) | content.cast("string").rlike(r"[\r\x00]") | ~F.endswith(content.cast("string"), F.lit("\n")),
    })
    readable = outputs.where((size <= MOST_OUTPUT) & F.is_valid_utf8(content.cast("string")))
    lines = output_lines(readable)
    keys = ["output_id", "declaration"]
    asked = expected.groupBy(*keys).agg(F.count("*").alias("n"))
    named = F.col("declaration")
    row = lambda df, rule, key: df.select("output_id", F.lit(rule).alias("rule"), key.alias("key"))
    stray = lines.where("not warning").join(asked.select(*keys), keys, "left_anti")
    reports = lines.where("declaration is not null").groupBy(*keys).agg(F.count("*").alias("lines"), F.count("axioms").alias("good"))
    told = asked.join(reports, keys, "left").where("not (lines <=> 1 and good <=> 1)")
    unfinished = lines.groupBy("output_id").agg(F.bool_or("warning").alias("warned"), F.coalesce(F.bool_or(F.exists("axioms", lambda a: F.contains(a, F.lit(UNFINISHED)))), F.lit(False)).alias("explained"))
    return (
        of_output.select("output_id", "rule", F.lit(None).cast("string").alias("key"))
        .unionAll(row(outputs.join(expected, "output_id", "left_anti"), "nothing is expected", F.lit(None).cast("string")))
        .unionAll(row(asked.where((F.col("n") > 1) | named.isNull() | ~named.rlike(r"^[^\n\r\x00]+$")), "expected names are malformed", named))
        .unionAll(row(stray, "line is no expected report", F.col("line")))
        .unionAll(row(told, "not one well-formed report", named))
        .unionAll(row(unfinished.where("warned and not explained"), "warning without a report", F.lit(None).cast("string")))
    )


def exact_reports(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """output_id, declaration, axioms: one report of each expected declaration.  Raises where
    :func:`report_violations` has a row."""
    require(report_violations(outputs, expected).select("rule", F.coalesce("key", F.col("output_id").cast("string")).alias("key")), "UNUSABLE_REPORT")
    return output_lines(outputs).where("declaration is not null").select("output_id", "declaration", "axioms")


#: The fields of a detached report.
_SIDECAR = "struct<schema:string,artifact:struct<identity:string,source_revision:string>,corpus_class:string,declaration:string,lean_audit:struct<toolchain:string,command:string,transcript_sha256:string,observed_axioms:array<string>,allowed_axioms:array<string>>>"
_FIELDS = {"$": ["schema", "artifact", "corpus_class", "declaration", "lean_audit"], "$.artifact": ["identity", "source_revision"], "$.lean_audit": ["toolchain", "command", "transcript_sha256", "observed_axioms", "allowed_axioms"]}


def bound_evidence(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """evidence_id, eligibility, broken of detached reports that are pinned by digest.

    ``evidence``: evidence_id, sidecar and transcript (binary), expected_sha256, and identity and
    revision of the artifact that they must be of.  ``nodes`` has the artifacts' identity and
    full_name.  Rows with neither of the three are of unknown eligibility; all others are judged
    if they break no rule, else ``broken`` has the rules in order of their names and eligibility
    is null.
    """
    body = F.decode("sidecar", "UTF-8")
    rows = evidence.withColumns({"body": body, "doc": F.from_json(body, _SIDECAR)})
    exactly = F.lit(True)
    for path, fields in _FIELDS.items():
        inner = F.col("body") if path == "$" else F.get_json_object("body", path)
        exactly = exactly & (F.array_sort(F.json_object_keys(inner)) == F.array(*[F.lit(f) for f in sorted(fields)]))
    d, audit = F.col("doc"), F.col("doc.lean_audit")
    text = F.decode("transcript", "UTF-8")
    name, details = (F.regexp_extract(F.regexp_replace(text, r"\n\z", ""), _REPORT, k) for k in (1, 2))
    names = lambda c: (F.size(F.array_distinct(c)) == F.size(c)) & ~F.exists(c, lambda x: x.isNull() | (x == "") | (F.trim(x) != x))
    given = [F.col(c).isNotNull() for c in ("sidecar", "transcript", "expected_sha256")]
    asked, whole = given[0] | given[1] | given[2], given[0] & given[1]
    known = nodes.select(F.col("identity"), F.col("full_name").alias("declaration"), F.lit(True).alias("held")).distinct()
    met = rows.withColumn("declaration", d["declaration"]).join(known, ["identity", "declaration"], "left")
    # what follows from a missing part is not told again
    rules = {
        INCOMPLETE: ~whole,
        UNPINNED_SIDECAR: whole & ~is_hex64(F.coalesce("expected_sha256", F.lit(""))),
        SIDECAR_MISMATCH: whole & ~F.sha2("sidecar", 256).eqNullSafe(F.col("expected_sha256")),
        TOO_LARGE: whole & ((F.octet_length("sidecar") > MOST_EVIDENCE) | (F.octet_length("transcript") > MOST_EVIDENCE)),
        "sidecar is malformed": whole & ~F.coalesce(exactly & F.try_parse_json("body").isNotNull() & (d["schema"] == SIDECAR) & d["corpus_class"].isin(CORPUS_CLASSES) & (audit["toolchain"] != "") & names(audit["observed_axioms"]) & names(audit["allowed_axioms"]), F.lit(False)),
        "audit is of another command": whole & ~(audit["command"].eqNullSafe(F.concat(F.lit("#print axioms "), d["declaration"]))),
        "transcript differs from its digest": whole & ~audit["transcript_sha256"].eqNullSafe(F.sha2("transcript", 256)),
        "transcript is no report of these axioms": whole & ~F.coalesce((name == d["declaration"]) & F.endswith(text, F.lit("\n")) & ~text.rlike(r"(?s)\n.*\n|[\r\x00]") & (report_axioms(details) == audit["observed_axioms"]), F.lit(False)),
        "evidence is of another artifact": whole & ~(d["artifact"]["identity"].eqNullSafe(F.col("identity")) & d["artifact"]["source_revision"].eqNullSafe(F.col("revision"))),
        "artifact lacks the declaration": whole & F.col("held").isNull(),
    }
    marks = F.array_sort(F.array_compact(F.array(*[F.when(asked & bad, F.lit(rule)) for rule, bad in rules.items()])))
    judged = met.withColumn("broken", marks)
    verdict = F.when(~asked, UNKNOWN_PROOF).when(F.size("broken") == 0, eligibility(d["corpus_class"], audit["observed_axioms"], audit["allowed_axioms"]))
    return judged.select("evidence_id", verdict.alias("eligibility"), "broken")


def verdict_differences(reports: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (output_id, declaration, verdict, side) by which the verdicts of exact reports on a
    proof corpus differ from the expected ones."""
    verdict = eligibility(F.lit(PROOF_CORPUS), F.col("axioms"), F.array().cast("array<string>"))
    return difference(reports.select("output_id", "declaration", verdict.alias("verdict")), expected.select("output_id", "declaration", "verdict"))


# ---------------------------------------------------------------- probes


def probe_state(kind: Column, n: Column, mode: Column, error: Column | None = None) -> Column:
    """State of a smoke probe by its kind, its number of hits or edges, and the code of the
    error it met."""
    error = F.lit(None).cast("string") if error is None else error
    search = F.when(n == 0, "NO_SIGNAL").when(mode == "evidence", "FOUND_USEFUL_STRUCTURE").otherwise("CANDIDATE_SIGNAL")
    graph = F.when(error == "UNKNOWN", "UNKNOWN_WITHIN_CURRENT_CONTRACT").when(error.isNotNull(), "DEGRADED").when(n > 0, "FOUND_USEFUL_STRUCTURE").otherwise("NO_SIGNAL")
    return F.when(kind == "search", search).when(kind.isin("deps", "rdeps"), graph).otherwise("CORPUS_BOUNDARY")


def regression(guard: Column, n: Column, least: Column, required: Column, observed: Column, error: Column | None = None) -> Column:
    """Whether a guarded probe met an error, found too little or lacks what it must find."""
    none = F.array().cast("array<string>")
    missing = F.size(F.array_except(F.coalesce(required, none), F.coalesce(observed, none))) > 0
    failed = F.lit(False) if error is None else error.isNotNull()
    return F.coalesce(guard, F.lit(False)) & (failed | (F.coalesce(n, F.lit(0)) < F.coalesce(least, F.lit(0))) | missing)


def disposition(probes: DataFrame) -> DataFrame:
    """One row: the overall state of probes (state, regression) by precedence."""
    has = lambda s: F.coalesce(F.bool_or(F.col("state") == s), F.lit(False))
    bad = F.coalesce(F.bool_or(F.col("regression")), F.lit(False)) | has("DEGRADED")
    useful = has("FOUND_USEFUL_STRUCTURE")
    return probes.agg(
        F.when(bad, "DEGRADED").when(useful, "FOUND_USEFUL_STRUCTURE").when(has("CORPUS_BOUNDARY"), "CORPUS_BOUNDARY").when(has("NO_SIGNAL"), "NO_SIGNAL").otherwise("UNKNOWN_WITHIN_CURRENT_CONTRACT").alias("disposition"),
        F.count("*").alias("n_probes"),
    )
