"""They must equal the ones in use for results to agree."""

# Statuses and kinds.
PASSING_LOCK_STATUSES = ["verified_official_bibtex", "verified_manual_fallback", "arxiv_fallback_verified"]
BLOCKED_SOURCE_KINDS = ["generated_unverified", "unknown"]
FALLBACK_SOURCE_KINDS = ["publisher_metadata_manual_normalized", "arxiv_manual_normalized"]
DOI_ABSENCE_CHECKS = ["missing", "not_applicable", "absent"]
PASSING_CLAIM_STATUSES = ["checked", "checked_arxiv"]
BLOCKING_CLAIM_STATUSES = ["too_strong", "wrong_source", "delete_or_rewrite", "claim_unchecked", "needs_review", "needs_review_weak_evidence"]
WEAK_EVIDENCE_KINDS = ["abstract", "summary", "metadata_summary", "semantic_scholar_abstract", "openalex_abstract", "arxiv_summary"]

# Words.
STOP_TERMS = (
    "about after again against also and are because been before between both can cite does for from has have into its may more "
    "not our over paper show shows such than that the their these this those through using was were which with"
).split()
STRONG_TERMS = ["always", "best", "guarantee", "guarantees", "never", "outperform", "outperforms", "prove", "proves", "significant", "state-of-the-art"]
HEDGE_TERMS = ["approximately", "can", "could", "indicate", "indicates", "may", "might", "suggest", "suggests"]
WEIGHTY_TERMS = ["outperform", "state-of-the-art", "benchmark", "result", "achieve", "improve", "compare", "shows", "demonstrates"]
RESULT_TERMS = ["benchmark", "result", "outperform", "accuracy", "score"]
METHOD_TERMS = ["method", "approach", "propose", "framework"]
SENSITIVE_TERMS = ["/Users/", "Obsidian", "API key", "token", "password", "secret"]
HEADINGS = ["abstract", "introduction", "related work", "background", "method", "methods", "experiments", "evaluation", "results", "discussion", "conclusion"]

# Decisions of reviews.
REVIEW_DECISIONS = ["supported", "checked", "needs_review", "too_strong", "wrong_source", "no_evidence", "delete_or_rewrite", "unsupported"]
TITLE_DECISIONS = ["accepted_mismatch", "source_title_mismatch_accepted", "accepted_official_metadata_mismatch"]

# Scores and cuts of the resolver.
DOI_SCORE, ARXIV_SCORE, TITLE_SCORE, YEAR_SCORE, AUTHOR_SCORE, OFFICIAL_SCORE, BIBTEX_SCORE = 100, 98, 60, 10, 10, 15, 5
ACCEPTED_SCORE, NEAR_TIE = 90, 3

# Phases of issues, by code prefix, first match counts; the last phase takes the rest.
PHASES = ["bibliography", "source-title", "claim review", "manuscript"]
PHASE_PREFIXES = [
    ("SOURCE_TITLE", "source-title"),
    ("CLAIM", "claim review"),
    ("SOURCE_TEXT", "claim review"),
    ("PDF_TEXT_EXTRA_MISSING", "claim review"),
    ("CITATION", "manuscript"),
    ("BIB_ENTRY", "manuscript"),
    ("TEX", "manuscript"),
]

# publishers' names as they are written.
PUBLISHERS = {
    "association for computing machinery": "ACM",
    "acm": "ACM",
    "ieee": "IEEE",
    "ieee computer society": "IEEE Computer Society",
    "springer": "Springer",
    "springer nature": "Springer Nature",
    "elsevier": "Elsevier",
}

# Words in a venue's name or address that speak for a source, in order.
VENUE_HINTS = [
    ("acl", ["association for computational linguistics", "acl", "emnlp", "aclanthology.org"]),
    ("acm", ["acm", "dl.acm.org"]),
    ("aaai", ["aaai", "aaai.org"]),
    ("cambridge", ["cambridge", "cambridge.org", "cambridge core"]),
    ("cvf", ["cvf", "cvpr", "iccv", "eccv", "openaccess.thecvf.com"]),
    ("elsevier", ["elsevier", "sciencedirect.com"]),
    ("frontiers", ["frontiers", "frontiersin.org"]),
    ("iclr", ["learning representations", "iclr", "iclr.cc"]),
    ("ieee", ["ieee", "cvpr", "iccv", "ieeexplore.ieee.org"]),
    ("jmlr", ["jmlr", "journal of machine learning research", "jmlr.org"]),
    ("lipics", ["lipics", "dagstuhl", "drops.dagstuhl.de"]),
    ("mdpi", ["mdpi", "mdpi.com"]),
    ("nature", ["nature", "nature.com", "nature machine intelligence", "scientific reports"]),
    ("neurips", ["neural information processing", "neurips", "proceedings.neurips.cc"]),
    ("openreview", ["openreview", "openreview.net", "tmlr"]),
    ("oxford", ["oxford", "academic.oup.com", "oup"]),
    ("pmlr", ["pmlr", "proceedings.mlr.press", "machine learning research"]),
    ("pnas", ["pnas", "proceedings of the national academy", "pnas.org"]),
    ("sage", ["sage", "journals.sagepub.com"]),
    ("science", ["science", "science.org"]),
    ("springer", ["springer", "link.springer.com"]),
    ("taylorfrancis", ["taylor & francis", "taylor and francis", "tandfonline.com"]),
    ("usenix", ["usenix", "usenix.org"]),
    ("wiley", ["wiley", "onlinelibrary.wiley.com"]),
]

# publishers' record pages: source, label, host.
VENUES = [
    ("aaai", "AAAI", "aaai.org"),
    ("acl", "ACL Anthology", "aclanthology.org"),
    ("acm", "ACM", "dl.acm.org"),
    ("cambridge", "Cambridge Core", "cambridge.org"),
    ("cvf", "CVF Open Access", "openaccess.thecvf.com"),
    ("elsevier", "Elsevier", "sciencedirect.com"),
    ("frontiers", "Frontiers", "frontiersin.org"),
    ("iclr", "ICLR", "iclr.cc"),
    ("ieee", "IEEE", "ieeexplore.ieee.org"),
    ("jmlr", "JMLR", "jmlr.org"),
    ("lipics", "LIPIcs", "drops.dagstuhl.de"),
    ("mdpi", "MDPI", "mdpi.com"),
    ("nature", "Nature Portfolio", "nature.com"),
    ("neurips", "NeurIPS", "neurips.cc"),
    ("openreview", "OpenReview", "openreview.net"),
    ("oxford", "Oxford Academic", "academic.oup.com"),
    ("pmlr", "PMLR", "proceedings.mlr.press"),
    ("pnas", "PNAS", "pnas.org"),
    ("sage", "SAGE", "journals.sagepub.com"),
    ("science", "Science", "science.org"),
    ("springer", "Springer", "link.springer.com"),
    ("taylorfrancis", "Taylor & Francis", "tandfonline.com"),
    ("usenix", "USENIX", "usenix.org"),
    ("wiley", "Wiley", "onlinelibrary.wiley.com"),
]
MONITOR_SOURCES = sorted([s for s, _, _ in VENUES] + ["crossref"])
# Indexes that are looked up besides: source, priority, kind of record (none: for discovery only).
INDEXES = [("arxiv", 2, "preprint_record"), ("crossref", 2, "doi_metadata"), ("openalex", 4, None), ("semantic_scholar", 4, None)]

# Hosts that a PDF's address speaks for, first match counts.
PDF_HOSTS = [
    ("arxiv.org/", "arxiv"),
    ("aclanthology.org/", "acl"),
    ("proceedings.iclr.cc/", "iclr"),
    ("openreview.net/", "openreview"),
    ("proceedings.neurips.cc/", "neurips"),
    ("proceedings.mlr.press/", "pmlr"),
    ("dl.acm.org/", "acm"),
    ("openaccess.thecvf.com/", "cvf"),
    ("jmlr.org/", "jmlr"),
    ("link.springer.com/", "springer"),
    ("academic.oup.com/", "oxford"),
    ("cambridge.org/", "cambridge"),
    ("pnas.org/", "pnas"),
    ("science.org/", "science"),
    ("frontiersin.org/", "frontiers"),
    ("mdpi.com/", "mdpi"),
    ("drops.dagstuhl.de/", "lipics"),
]

# Kinds of CSL items; months by their first letters.
CSL_KINDS = {
    "article": "article-journal",
    "inproceedings": "paper-conference",
    "proceedings": "paper-conference",
    "book": "book",
    "inbook": "chapter",
    "incollection": "chapter",
    "phdthesis": "thesis",
    "mastersthesis": "thesis",
    "techreport": "report",
    "misc": "webpage",
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

# What issues say, by code; {} stands for what the row itself adds.
MESSAGES = {
    "MISSING_LOCK_ENTRY": "BibTeX entry has no lockfile entry.",
    "NON_PASSING_STATUS": "Lockfile status is {}.",
    "UNVERIFIED_BIBTEX_SOURCE": "BibTeX source kind is {}.",
    "OFFICIAL_EXPORT_NOT_USED": "Official BibTeX endpoint exists, but entry is not marked as official export.",
    "OFFICIAL_EXPORT_CONTENT_CHANGED": "Current BibTeX entry differs from the reviewed official export checksum.",
    "OFFICIAL_EXPORT_CHECKSUM_MISSING": "Official BibTeX export has no reviewed checksum in the lockfile.",
    "TITLE_MISMATCH": "BibTeX title does not match lockfile record title.",
    "YEAR_MISMATCH": "BibTeX year does not match lockfile record year.",
    "AUTHOR_MISMATCH": "BibTeX first author does not match lockfile record first author.",
    "FALLBACK_REASON_MISSING": "Manual fallback BibTeX requires a fallback reason.",
    "ARXIV_ACCESSED_DATE_MISSING": "arXiv fallback entry requires an accessed date.",
    "ARXIV_FALLBACK": "Entry uses arXiv fallback rather than final publication BibTeX.",
    "DOI_MISSING": "Lockfile record or BibTeX entry has no DOI.",
    "LOCK_ENTRY_NOT_IN_BIB": "Lockfile entry is not present in the BibTeX file.",
    "CITATION_NOT_IN_BIB": "Citation key appears in manuscript but is missing from the BibTeX file.",
    "BIB_ENTRY_NOT_CITED": "BibTeX entry is not cited in the manuscript.",
    "CLAIM_TABLE_SCHEMA_INVALID": "Claim table is missing required columns.",
    "CLAIM_NOT_CHECKED": "Claim {} is not marked checked.",
    "CLAIM_SOURCE_LOCATION_MISSING": "Claim {} is checked but has no source location.",
    "CLAIM_EVIDENCE_MISSING": "Claim {} has no evidence text.",
    "CLAIM_EVIDENCE_LOW_OVERLAP": "Claim {} has low lexical overlap with its evidence.",
    "CLAIM_MAY_BE_TOO_STRONG": "Claim {} uses strong wording that needs careful source support.",
    "CLAIM_STATUS_NOT_FINAL": "Claim {} has evidence but is not marked checked.",
    "CLAIM_WEAK_EVIDENCE_NOT_CHECKABLE": "Claim {} is marked checked using weak evidence.",
    "SOURCE_MAP_MISSING": "Source map file does not exist.",
    "SOURCE_TEXT_MISSING_FOR_CITATION": "No source text/PDF was mapped for a cited claim.",
    "CLAIM_EVIDENCE_NOT_FOUND_IN_SOURCE": "Mapped source text was provided, but no overlapping evidence block was found.",
    "SOURCE_TEXT_TOO_SHORT": "Extracted source text is shorter than the configured minimum.",
    "SOURCE_TEXT_READ_FAILED": "Source text could not be read or extracted.",
    "PDF_TEXT_EXTRA_MISSING": "PDF source text extraction requires the optional pypdf dependency.",
    "SOURCE_TITLE_LOCK_ENTRY_MISSING": "Source title check could not find a matching lockfile entry.",
    "SOURCE_TITLE_EXPECTED_TITLE_MISSING": "Lockfile entry has no title to compare against the source file.",
    "SOURCE_TITLE_READ_FAILED": "Source file could not be read for title validation.",
    "SOURCE_TITLE_CANDIDATE_MISSING": "No plausible first-page title candidate was found in the source file.",
    "SOURCE_TITLE_MISMATCH": "The source file title does not match the lockfile/BibTeX title.",
    "SOURCE_TITLE_MISMATCH_REVIEWED": "The source file title differs from the lockfile/BibTeX title, and the mismatch has an accepted source-title review record.",
    "SOURCE_TITLE_REVIEW_PATH_MISMATCH": "A matching source-title review exists, but its source_text does not match the current source-map row.",
    "NO_CANDIDATES": "No candidate records were provided.",
    "LOW_CONFIDENCE": "No candidate reached the automatic resolution threshold.",
    "DOI_CONFLICT": "Multiple high-confidence candidates disagree on DOI.",
    "MULTIPLE_OFFICIAL_RECORDS": "Multiple official record URLs were found.",
    "AUTHORITY_TITLE_MISSING": "The selected authority candidate has no title and cannot safely verify the bibliography title.",
    "AUTHORITY_TITLE_MISMATCH": "The selected authority candidate title does not exactly match the bibliography title.",
    "OFFICIAL_RECORD_PENDING": "Only an arXiv preprint record was found while a preferred official venue was requested.",
    "REFERENCE_CANDIDATES_MISSING": "No fixture or live candidate records were available for this reference.",
    "REFERENCE_LIVE_LOOKUP_FAILED": "{} live lookup failed for this reference.",
    "OFFICIAL_BIBTEX_TITLE_MISMATCH": "Official BibTeX export title does not match the selected authority record title.",
    "OFFICIAL_BIBTEX_DOI_MISMATCH": "Official BibTeX export DOI does not match the selected authority record DOI.",
    "OFFICIAL_BIBTEX_FETCH_FAILED": "Official BibTeX export could not be fetched from the selected authority URL.",
    "BIBTEX_PROVENANCE_AMBIGUOUS": "Multiple BibTeX files have an exact normalized title match for this reference.",
    "BIBTEX_PROVENANCE_INPUT_MISSING": "A selected reference cannot update the lockfile without an official BibTeX file or arXiv fallback metadata.",
    "TEX_INCLUDE_DEPTH_EXCEEDED": "TeX include recursion exceeded the configured depth limit.",
    "TEX_INCLUDE_CYCLE": "TeX include graph contains a cycle.",
    "TEX_INCLUDE_MISSING": "Referenced TeX include file is missing.",
    "SOURCE_DOWNLOAD_URL_MISSING": "No deterministic source PDF URL could be derived from the lockfile entry.",
    "SOURCE_DOWNLOAD_LOCK_ENTRY_MISSING": "Requested citation key is not present in the lockfile.",
    "SOURCE_DOWNLOAD_FAILED": "Source PDF download failed.",
}
# What issues of these codes say where there is more to say, or more than one reason.
MESSAGES_TOLD = {
    "CLAIM_NOT_CHECKED": "Claim {} is marked {}.",
    "CLAIM_EVIDENCE_MISSING": "Claim {} is checked but has no evidence text.",
    "CLAIM_WEAK_EVIDENCE_NOT_CHECKABLE": "Claim {} is marked checked using weak evidence kind {}.",
    "DOI_MISSING in the record": "Lockfile record has no DOI.",
    "DOI_MISSING in the entry": "BibTeX entry is missing DOI present in the lockfile record.",
}
# What is said of all claims with an issue, where issues are counted by code.
CLAIMS_SAY = {
    "CLAIM_NOT_CHECKED": "Claims are not marked checked.",
    "CLAIM_STATUS_NOT_FINAL": "Claims have evidence but are not marked checked.",
    "CLAIM_EVIDENCE_LOW_OVERLAP": "Claims have low lexical overlap with their evidence.",
    "CLAIM_EVIDENCE_MISSING": "Claims have no evidence text.",
    "CLAIM_SOURCE_LOCATION_MISSING": "Claims are checked but have no source location.",
    "CLAIM_MAY_BE_TOO_STRONG": "Claims use strong wording that needs careful source support.",
    "CLAIM_WEAK_EVIDENCE_NOT_CHECKABLE": "Claims use weak evidence that cannot be marked checked.",
}
# Codes that stand for a claim in place of CLAIM_NOT_CHECKED.
CLAIM_REPRESENTATIVES = [
    "CLAIM_STATUS_NOT_FINAL",
    "CLAIM_EVIDENCE_LOW_OVERLAP",
    "CLAIM_EVIDENCE_MISSING",
    "CLAIM_SOURCE_LOCATION_MISSING",
    "CLAIM_WEAK_EVIDENCE_NOT_CHECKABLE",
    "CLAIM_MAY_BE_TOO_STRONG",
    "CLAIM_EVIDENCE_NOT_FOUND_IN_SOURCE",
]
# Claim issues that ask for sources to be mapped or reviewed.
CLAIM_BLOCKERS = ["CLAIM_NOT_CHECKED", "CLAIM_STATUS_NOT_FINAL", "CLAIM_EVIDENCE_MISSING", "CLAIM_SOURCE_LOCATION_MISSING", "CLAIM_WEAK_EVIDENCE_NOT_CHECKABLE"]

# Words in a command that a path must stand for first.
PLACEHOLDERS = ["LOCK", "PAPER_BIB", "PAPER_TEX", "SOURCES_DIR", "REFERENCE_CANDIDATES_DIR", "REVIEWED_FALLBACK_BIBTEX_DIR", "OFFICIAL_BIBTEX_DIR", "OFFICIAL_HTML_DIR"]
