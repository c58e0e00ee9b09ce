"""Reports of one manuscript in Markdown and JSON: rows are summed up before, and what is rendered here is small."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.functions.constants import PHASES
from provlake.operators import rollup

PHASE_ORDER = ["bibliography", "manuscript", "source-title", "claim review"]
LISTED = 10


def listed(items: Iterable[str], most: int | None = None, what: str = "more") -> list[str]:
    items = list(items)
    shown = items if most is None else items[:most]
    return [f"- {x}" for x in shown] + ([f"- ... {len(items) - len(shown)} {what}"] if len(items) > len(shown) else [])


def code(text: Any) -> str:
    return f"`{text or ''}`"


def group_line(r: Any) -> str:
    """A group of issues: code, n, message, and some of its keys."""
    keys = ", ".join(code(k) for k in r["sample"].split(",") if k)
    more = f", ... {r['omitted']} more" if r["omitted"] else ""
    return f"{code(r['code'])} x{r['n']}: {r['message']}" + (f" ({keys}{more})" if keys else "")


def groups(issues: DataFrame) -> list[Any]:
    return rollup.issue_groups(issues).orderBy("ord").collect()


def phase_lines(issues: DataFrame) -> list[str]:
    """A line for each phase, also of those without issues."""
    found = {r["phase"]: r for r in rollup.phases(issues.sparkSession, issues).collect()}
    assert set(found) == set(PHASES)
    return [f"- {p}: {found[p]['status']} ({found[p]['blocking']} blocking, {found[p]['warnings']} warnings)" for p in PHASE_ORDER]


def issue_lines(issues: DataFrame) -> list[str]:
    return [f"{code(r['code'])}{' ' + code(r['citation_key']) if r['citation_key'] else ''}: {r['message']}" for r in issues.orderBy("ord").collect()]


def audit(lock: DataFrame, issues: DataFrame, notes: DataFrame) -> str:
    """The audit of one manuscript. lock: entries; issues and notes: ord, code, severity, message, citation_key."""
    from provlake.operators.locks import by_source_kind

    kinds = by_source_kind(lock).orderBy("citation_key").collect()
    blocking, warnings, accepted = issue_lines(issues.where("severity = 'blocking'")), issue_lines(issues.where("severity = 'warning'")), issue_lines(notes)
    claims = groups(issues.where("startswith(code, 'CLAIM_')"))
    out = ["# Audit", "", "## Summary", "", f"- Entries: {lock.count()}", f"- Blocking issues: {len(blocking)}", f"- Warnings: {len(warnings)}", f"- Accepted provenance notes: {len(accepted)}", "", "## Phase Status", "", *phase_lines(issues)]
    for title, lines in (("Blocking Issues", blocking), ("Warnings", warnings), ("Accepted Provenance Notes", accepted)):
        out += ["", f"## {title}", "", *(listed(lines) or ["- None"])]
    for title, section in (("Verified Official BibTeX", "official"), ("Manual Fallbacks", "manual"), ("arXiv Fallbacks", "arxiv")):
        out += ["", f"## {title}", "", *(listed(f"{code(r['citation_key'])} — {r['detail']}" for r in kinds if r["section"] == section) or ["- None"])]
    out += ["", "## Claim-to-Source Status", "", *(listed(map(group_line, claims)) or ["- No claim issues reported"]), "", "## Submission Checklist", ""]
    out += [f"- [{' ' if blocking else 'x'}] Blocking issue count is zero.", "- [ ] Every citation key has a lockfile entry.", "- [ ] Official BibTeX export entries use `official_export`."]
    out += ["- [ ] Manual fallback entries include fallback reason and field checks.", "- [ ] arXiv fallback entries include version and accessed date.", "- [ ] Important claims have source locations and evidence spans.", ""]
    return "\n".join(out)


def claims(table: DataFrame) -> str:
    """The claims of one manuscript with their evidence. table: ord and the columns of claims."""
    rows = table.orderBy("ord").collect()
    done = sum(r["status"] == "checked" for r in rows)
    out = ["# Claim Review", "", "## Summary", "", f"- Claims: {len(rows)}", f"- Checked: {done}", f"- Needs review: {len(rows) - done}", "", "## Claims", "", *([] if rows else ["- None"])]
    for r in rows:
        out += [f"### {r['claim_id']} — {code(r['citation_key'])}", "", f"- Status: {code(r['status'])}", f"- Location: {r['manuscript_location']}", f"- Source file: {r['source_file'] or '(unknown)'}", f"- Type: {r['claim_type']}", f"- Importance: {r['importance']}"]
        out += ["", "Claim:", "", r["claim_text"], "", "Evidence:", "", r["quote_or_evidence"] or "(missing)", "", f"Source location: {r['source_location'] or '(missing)'}", ""]
    return "\n".join(out).rstrip() + "\n"


def claim_sources(source_map: str | None, n_sources: int, n_claims: int, suggestions: DataFrame, issues: DataFrame, most: int | None = LISTED) -> str:
    """Claims against their sources: what is missing, what was suggested, what blocks. issues: ord, code, severity, message, citation_key, claim_id."""
    blocking, warnings = issues.where("severity = 'blocking'"), issues.where("severity = 'warning'")
    found, told = groups(blocking), suggestions.collect()
    rows = blocking.orderBy("ord").collect()
    keys = sorted({r["citation_key"] for r in rows if r["code"] == "SOURCE_TEXT_MISSING_FOR_CITATION"})
    vain = [f"{code(r['claim_id'])} / {code(r['citation_key'])}" for r in rows if r["code"] == "CLAIM_EVIDENCE_NOT_FOUND_IN_SOURCE"]
    soft = issue_lines(warnings)
    out = ["", "## Claim Source Check", "", f"- Source map: {source_map or '(none)'}", f"- Sources: {n_sources}", f"- Claims: {n_claims}", f"- Evidence suggestions: {len(told)}", f"- Blocking groups: {len(found)}", f"- Blocking rows needing review: {len(rows)}", f"- Warnings: {len(soft)}", ""]
    shown = [f"{code(r['claim_id'])} / {code(r['citation_key'])}: {r['source_location']} (overlap {r['overlap']}, coverage {r['coverage']})" for r in told]
    for title, lines in (("Missing Source Files", map(code, keys)), ("No Evidence Match In Mapped Source", vain), ("Evidence Suggestions Awaiting Review", shown), ("Blocking Issue Groups", map(group_line, found)), ("Warnings", soft)):
        if part := listed(lines, most):
            out += [f"### {title}", "", *part, ""]
    step = "Keep mapped claims blocked until source evidence is reviewed and imported with `import-review`." if rows else "Review evidence suggestions and import a checked review only after direct source review." if told else "No claim-source action required."
    return "\n".join([*out, "### Next Action", "", f"- {step}"]).rstrip() + "\n"


def claim_review(table: DataFrame, source_map: str | None, n_sources: int, suggestions: DataFrame, issues: DataFrame) -> str:
    """The claims, and after them the queues of their source check, whole."""
    section = claim_sources(source_map, n_sources, table.count(), suggestions, issues, None)
    return claims(table).rstrip() + "\n" + section


def source_titles(checked: DataFrame, source_map: str) -> str:
    """Sources whose first page bears another title. checked: see ``titles.check``."""
    rows = checked.orderBy("ord").collect()
    reviewed = [r for r in rows if r["code"] == "SOURCE_TITLE_MISMATCH_REVIEWED"]
    failing = [r for r in rows if not r["ok"]]
    out = ["", "## Source Title Check", "", f"- Source map: {source_map}", f"- Checked sources: {len(rows)}", f"- Passing sources: {len(rows) - len(failing)}", f"- Reviewed mismatches: {len(reviewed)}", f"- Blocking issues: {len(failing)}", ""]
    for title, some in (("Reviewed Mismatches", reviewed), ("Review Required", failing)):
        if some:
            out += [f"### {title}", "", *listed(f"{code(r['citation_key'])}: expected {code(r['expected_title'])}; source candidate {code(r['candidate'] or '(no candidate)')}" for r in some), ""]
    return "\n".join(out).rstrip() + "\n"


def action_summary(plan: DataFrame) -> str:
    """What is left of the actions of several manifests. plan: see ``actions.planned``, with a manifest."""
    from provlake.operators import actions

    left = actions.remaining(plan).orderBy("manifest", "ord").collect()
    counts = actions.manifest_summary(plan).orderBy("status").collect()
    n = plan.select("manifest").distinct().count()
    out = ["# Next-Action Summary", "", f"- Status: {'needs action' if left else 'pass'}", f"- Manifests: {n}", f"- Actions: {sum(r['n'] for r in counts)}", f"- Remaining: {len(left)}", f"- Failed: {sum(r['n'] for r in counts if r['status'] == 'failed')}"]
    if counts:
        out += ["", "## Status Counts", *(f"- {code(r['status'])}: {r['n']}" for r in counts)]
    first = next((r for r in left if r["selected"] and r["chosen"]), next((r for r in left if r["chosen"]), None))
    if first is not None:
        out += ["", "## Recommended Next", f"- Code: {code(first['code'])}", f"- Action: {first['summary']}", *([f"- Blocker: {code(first['skip_reason'])}"] if first["skip_reason"] else []), f"- Hint: {first['hint']}", "", "```bash", first["chosen"], "```"]
    if left:
        out += ["", "## Remaining Actions"]
        for r in left:
            out += ["- " + " / ".join(x for x in (r["status"], r["code"], r["citation_key"]) if x), f"  - Action: {r['summary']}", f"  - Hint: {r['hint']}", *([f"  - Command: {code(r['chosen'])}"] if r["chosen"] else [])]
    return "\n".join(out).rstrip() + "\n"


def review_bundle(bundle: DataFrame) -> str:
    """A queue for a reviewer. bundle: see ``claim_sources.review_bundle``."""
    out = ["# Claim Review Bundle", "", "Verify each claim against the cited source text/PDF before writing review results.", "", "## Claims", ""]
    for r in bundle.orderBy("ord").collect():
        c = r["claim"]
        out += [f"### {c['claim_id']} — {code(c['citation_key'])}", "", f"- Location: {c['manuscript_location']}", f"- Source file: {c['source_file'] or '(unknown)'}", f"- Current status: {code(c['status'])}", f"- Importance: {code(c['importance'])}", "", "Claim:", "", c["claim_text"] or "(empty)", "", "References:", ""]
        for ref in map(json.loads, r["references"]):
            out.append(f"- {code(ref.get('citation_key'))}: {(ref.get('record') or {}).get('title') or '(missing title)'} [{ref.get('status', '')}]")
        out += ["", "Evidence candidates:", ""]
        held = [json.loads(x) for x in r["source_candidates"]]
        out += [] if held else ["- (no mapped source)"]
        for x in held:
            found = "found" if x.get("candidate_found") else "not_found"
            out.append(f"- {code(found)} {x.get('source_location') or x.get('path') or '(missing)'}")
            if x.get("quote_or_evidence"):
                bits = [f"confidence={x.get('confidence')}", f"overlap={x.get('overlap')}", f"coverage={x.get('coverage')}", f"quality={x.get('quality')}", *([f"section={x['section_heading']}"] if x.get("section_heading") else [])]
                out += [f"  - Evidence metadata: {', '.join(bits)}", f"  - Quote: {x['quote_or_evidence']}"]
        out += ["", "Review result template:", "", "```json", json.dumps(r["review_result_template"].asDict(), ensure_ascii=False, sort_keys=True), "```", ""]
    return "\n".join(out).rstrip() + "\n"


def envelope(status: str, data: Any = None, blocking: list | None = None, warnings: list | None = None, actions: list | None = None) -> str:
    """What a command answers, as JSON."""
    answer = {"ok": not blocking, "status": status, "data": data, "blocking_issues": blocking or [], "warnings": warnings or [], "next_actions": actions or []}
    return json.dumps(answer, ensure_ascii=False, indent=2, sort_keys=True)


def written(text: str, path: str) -> None:
    """A report's file, on the driver."""
    from pathlib import Path

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def lockfile(lock: DataFrame, project: str | None = None, generated_at: str | None = None) -> str:
    """One project's lockfile as JSON, entries by key."""
    entries = [json.loads(r["e"]) for r in lock.orderBy("citation_key").select(F.to_json(F.struct(*lock.drop("ord", "project").columns)).alias("e")).toLocalIterator()]
    return json.dumps({"schema_version": "lock.v1", "project": project, "generated_at": generated_at, "entries": entries, "audit_policy": {}}, ensure_ascii=False, indent=2, sort_keys=True)


def shown_path(path: str, base: str) -> str:
    """A path as it stands in a folder, if it lies there; else as it is."""
    from posixpath import relpath

    rel = relpath(path, base)
    return path if rel.startswith("..") else rel


def beside_claims(claims: str, name: str) -> str:
    """Where what belongs to a claims table goes by default: source_map.tsv, review.md."""
    from posixpath import basename, dirname, join, splitext

    stem = splitext(basename(claims))[0]
    return join(dirname(claims), f"{stem.removesuffix('_claims') if stem.endswith('_claims') else stem}_{name}")
