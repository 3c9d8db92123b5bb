"""The vocabularies of the support desk."""

from __future__ import annotations

#: Outcomes of a mined thread; the last one stands for any other.
OUTCOMES = ("resolved_directly", "needed_follow_up", "escalated", "no_clear_resolution")
#: What a model writes where it has no reference.
NO_REFERENCE = ("null", "none", "n/a")

#: Intents with their families, in the order in which ties are decided.
INTENTS = (
    ("reviewer_assignment", "review_workflow"),
    ("review_submission_help", "review_workflow"),
    ("paper_bidding", "review_workflow"),
    ("author_profile_compliance", "submission_compliance"),
    ("submission_upload_help", "submission_compliance"),
    ("submission_requirements", "submission_compliance"),
    ("submission_format_policy", "submission_compliance"),
    ("author_list_change", "submission_compliance"),
    ("review_decision_appeal", "appeals_integrity"),
    ("desk_reject_appeal", "appeals_integrity"),
    ("anonymity_violation", "appeals_integrity"),
    ("reviewer_workload_role", "committee"),
    ("committee_invitation", "committee"),
    ("cms_support", "systems"),
)
INTENT_NAMES = tuple(name for name, _ in INTENTS)
FALLBACK_INTENT = "cms_support"

#: The cues of each intent, matched as substrings of lower-cased text.
KEYWORDS = {
    "reviewer_assignment": ("reviewer", "assign", "assignment", "emergency reviewer", "add a reviewer", "reassign"),
    "review_submission_help": ("submit my review", "cannot submit review", "openreview down", "review site", "late review", "meta-review"),
    "paper_bidding": ("bidding", "bid", "reviewer preference"),
    "author_profile_compliance": ("dblp", "semantic scholar", "google scholar", "profile", "subject area", "conflict"),
    "submission_upload_help": ("upload", "resubmit", "restore", "withdrawn by mistake", "camera-ready file", "supplementary"),
    "submission_requirements": ("deadline", "due date", "eligible", "how do i submit", "camera-ready deadline", "abstract deadline"),
    "submission_format_policy": ("page limit", "appendix", "checklist", "format", "anonymized code", "template"),
    "author_list_change": ("add author", "remove author", "author order", "co-author", "author list"),
    "review_decision_appeal": ("appeal the decision", "unfair review", "rebuttal", "reconsider our paper", "review quality"),
    "desk_reject_appeal": ("desk reject", "desk-reject", "appeal the desk", "rejected for formatting"),
    "anonymity_violation": ("double blind", "double-blind", "anonymity", "de-anonymize", "identifying information"),
    "reviewer_workload_role": ("too many papers", "reduce my load", "volunteer to review", "senior program committee", "area chair"),
    "committee_invitation": ("invitation", "accept the invitation", "decline", "resend the link", "reactivate"),
    "cms_support": ("account", "login", "cannot log in", "email address", "duplicate account"),
}

#: Words left out of rankings.
RANKING_STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "to", "of", "and", "or", "in", "for")

LANE_FAQ, LANE_HUMAN = "faq", "human_review"

#: Upper bounds of the confidence bands; the last one takes whatever is left.
BANDS = (("<0.5", 0.5), ("0.5-0.6", 0.6), ("0.6-0.7", 0.7), ("0.7-0.8", 0.8), ("0.8-0.9", 0.9), ("0.9-1.0", 1.01))
