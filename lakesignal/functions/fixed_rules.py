"""The built-in clause rules, coverage categories and review texts.

These tables are data, kept as plain text in their natural order, because
results are only right when they agree word for word.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Factor:
    key: str
    label: str
    pattern: str


@dataclass(frozen=True)
class Rule:
    rule_id: str
    label: str
    severity: str
    patterns: tuple[str, ...]
    affects: str = ""
    explanation: str = ""
    factors: tuple[Factor, ...] = field(default=())


@dataclass(frozen=True)
class Category:
    category_id: str
    label: str
    importance: str
    patterns: tuple[str, ...]


# Factors of the non-compete rule.
NON_COMPETE_FACTORS = (
    Factor("duration_specified", "States how long the restriction lasts",
           r"for\s+(a\s+period\s+of\s+)?\(?\d+\)?\s*\(?\w*\)?\s*(day|month|year)s?"),
    Factor("geographic_scope_specified", "States a geographic area the restriction covers",
           r"(within\s+a\s+radius\s+of|world[-\s]?wide|anywhere\s+in|geographic(al)?\s+(area|territory|scope)|territory\s+of)"),
    Factor("consideration_mentioned", "States a payment made specifically in exchange for the restriction",
           r"(consideration|compensation|payment)\s+(paid|payable|of\s+rs\.?)[^.]{0,60}(non[-\s]?compete|restriction)"),
)

# Risk rules (all patterns are case-insensitive and dot-all).
RISK_RULES = (
    Rule("unilateral_termination", "Other party can terminate at will", "high",
         (r"(lessor|owner|landlord|company|employer)[^.]{0,120}?right to terminate[^.]{0,120}?at any (point|time)",
          r"terminate[^.]{0,60}?with or without notice[^.]{0,60}?at any time"),
         "the party who cannot terminate freely",
         "One side can end the agreement whenever it likes, while the other is held to the full term or a notice period. That asymmetry leaves you without the stability the contract appears to give you."),
    Rule("termination_without_notice", "Termination without notice or reason", "high",
         (r"terminated without notice and without assigning any reason",
          r"terminate[^.]{0,80}?without (any )?(prior )?notice"),
         "the employee or contractor",
         "Your engagement can be ended with no notice period and no reason given. You would have no warning and no stated grounds to contest."),
    Rule("penalty_multiplier", "Penalty charged at a multiple of the normal amount", "high",
         (r"(two|three|double|twice|thrice)\s*(\(\d\)\s*)?times?\s+the\s+(rent|lease|amount|fee)",
          r"damages calculated at\s+\w+\s+times"),
         "the tenant or paying party",
         "Breaching this term costs you a multiple of the usual payment, not the actual loss caused. Check the multiplier and what triggers it."),
    Rule("unilateral_change_of_terms", "Other party can change the terms later", "high",
         (r"terms and conditions[^.]{0,80}?subject to (future )?change by the (lessor|owner|company|employer)",
          r"(company|employer|lessor)[^.]{0,60}?reserves the right to (modify|amend|change)[^.]{0,60}?(terms|policy)"),
         "the party who cannot change terms",
         "The terms you are agreeing to can be altered by the other side after signing. What you sign today is not necessarily what binds you later."),
    Rule("non_compete", "Restriction on working elsewhere", "high",
         (r"non[-\s]?compete",
          r"not to[^.]{0,140}?(compete|competing)[^.]{0,80}?business",
          r"shall not[^.]{0,100}?engage[^.]{0,80}?(similar|competing) business"),
         "the employee or contractor",
         "You are restricted from competing, or from working with similar businesses, possibly after this agreement ends. Check how long it lasts and how broadly 'competing' is defined.",
         NON_COMPETE_FACTORS),
    Rule("deposit_forfeiture", "Deposit may be forfeited", "high",
         (r"(deposit|advance)[^.]{0,120}?(shall|may|will) be forfeit",
          r"forfeit[^.]{0,80}?(security )?deposit"),
         "the tenant or paying party",
         "Your deposit can be kept rather than returned in certain situations. Check exactly which situations, and whether they are within your control."),
    Rule("ip_assignment", "You give up ownership of what you create", "medium",
         (r"work for hire",
          r"(vest|vests|shall vest) (solely |exclusively )?with the company",
          r"irrevocably (and perpetually )?assigns"),
         "the consultant, freelancer or employee",
         "Everything you produce under this agreement belongs to the other side, often including rights that would otherwise stay yours. Check whether work you created beforehand is swept in too."),
    Rule("lock_in_period", "Lock-in period", "medium",
         (r"lock[-\s]?in period",
          r"shall not (vacate|leave|resign)[^.]{0,80}?before[^.]{0,60}?(months|years)"),
         "the tenant or employee",
         "You are committed for a minimum duration and cannot exit early without a penalty, even if your circumstances change."),
    Rule("auto_renewal", "Renews automatically", "medium",
         (r"automatically (convert|converts|renew|renews|be renewed)",
          r"shall (stand )?renewed automatically"),
         "both parties, but usually whoever forgets",
         "The agreement continues on its own unless you actively stop it. Missing the cancellation window means you are bound for another term."),
    Rule("broad_indemnity", "Broad indemnity obligation", "medium",
         (r"indemnify,? (and )?(defend,? )?(and )?hold harmless",
          r"shall[^.]{0,60}?indemnify[^.]{0,100}?(losses|damages|claims)"),
         "the indemnifying party",
         "You agree to cover the other side's losses, legal costs and damages. This can extend well beyond your own fault, so check what triggers it."),
    Rule("liquidated_damages", "Pre-agreed damages on breach", "medium",
         (r"liquidated damages",),
         "the breaching party",
         "A fixed sum is payable if you break this term, regardless of the actual loss suffered. You cannot argue the real damage was smaller."),
    Rule("maintenance_on_weaker_party", "Repairs and upkeep fall on you", "low",
         (r"minor repairs[^.]{0,140}?(shall be )?(carried out|borne|responsibility)[^.]{0,60}?tenant",
          r"day[-\s]?to[-\s]?day[^.]{0,80}?repairs[^.]{0,80}?tenant"),
         "the tenant",
         "Day-to-day repairs are your responsibility and expense. Usually reasonable, but worth knowing before you sign, and check where 'minor' ends."),
    Rule("assignment_restriction", "You cannot transfer or sublet", "low",
         (r"shall not sublet",
          r"not to sublet, assign or transfer"),
         "the tenant or contractor",
         "You cannot pass your rights to anyone else, including subletting, without written permission. Normal, but it removes an exit route."),
)

# Coverage categories.
COVERAGE_CATEGORIES = (
    Category("termination", "Termination", "high", (r"terminat", r"end(s|ing)? this agreement")),
    Category("notice_period", "Notice period", "high",
             (r"notice period",
              r"\bnotice\b[^.]{0,60}?(day|days|month|months|week|weeks)",
              r"(day|days|month|months|week|weeks)[^.]{0,40}?\bnotice\b")),
    Category("confidentiality", "Confidentiality", "medium", (r"confidential", r"non[-\s]?disclosure")),
    Category("ip_ownership", "IP ownership", "medium", (r"intellectual property", r"work for hire", r"\bcopyright\b")),
    Category("dispute_resolution", "Dispute resolution", "high", (r"dispute", r"arbitrat", r"jurisdiction of")),
    Category("liability", "Liability", "medium", (r"liabilit", r"indemnif")),
    Category("payment", "Payment terms", "high",
             (r"\brent\b", r"\bsalary\b", r"\bremuneration\b",
              r"\bfee(s)?\b[^.]{0,40}?payable",
              r"\bpaid\b[^.]{0,40}?(monthly|annually|per month|per annum)")),
    Category("renewal", "Renewal", "medium", (r"renew", r"extend(ed|s)? (this|the) (agreement|term|lease)")),
    Category("governing_law", "Governing law", "medium", (r"governing law", r"govern(ed)? by[^.]{0,40}?laws of", r"laws of india")),
)

# Question to raise per rule.
NEGOTIATION_QUESTIONS = {
    "unilateral_termination": "Can termination rights be made mutual, or a minimum notice period added for both sides?",
    "termination_without_notice": "What minimum notice period would apply if this clause were negotiated?",
    "penalty_multiplier": "What specifically triggers this penalty, and is the multiplier negotiable?",
    "unilateral_change_of_terms": "Can changes to terms require mutual written consent instead of unilateral notice?",
    "non_compete": "How broad is 'competing business' defined, and can the duration/scope be narrowed?",
    "deposit_forfeiture": "Under exactly which conditions is the deposit forfeited, and can that be tightened?",
    "ip_assignment": "Does this cover pre-existing work, and can that be carved out?",
    "lock_in_period": "Is there an exit option (e.g. paying a fee) before the lock-in period ends?",
    "auto_renewal": "Can the auto-renewal notice window be made longer or opt-in instead of opt-out?",
    "broad_indemnity": "Can indemnity be limited to losses caused by the indemnifying party's own fault?",
    "liquidated_damages": "Is the fixed sum proportionate to a realistic estimate of actual loss?",
}

# Keyword -> question category, first match wins.
QUESTION_CATEGORIES = (
    ("probation", "probation"),
    ("deposit", "security_deposit"),
    ("intellectual property", "intellectual_property"),
    ("employee", "employment_status"),
    ("employer-employee", "employment_status"),
    ("dispute", "dispute_resolution"),
    ("law govern", "governing_law"),
    ("jurisdiction", "governing_law"),
    ("notice", "notice_period"),
    ("terminat", "termination"),
    ("repair", "obligations"),
    ("vacate", "termination"),
    ("term of this lease", "duration"),
    ("other client", "working_restrictions"),
    ("remuneration", "compensation"),
    ("rent due", "compensation"),
    ("paid late", "compensation"),
    ("lease amount", "compensation"),
)

# Obligation categories, overview statuses and overview fields.
OBLIGATION_CATEGORIES = ("payment", "notice", "renewal", "termination", "deliverable", "confidentiality", "liability", "other")
OVERVIEW_STATUSES = ("found", "not_found", "unclear", "insufficient_evidence")
OVERVIEW_FIELDS = (
    ("effective_date", "Effective date"),
    ("expiry_date", "Expiry date"),
    ("duration", "Duration"),
    ("renewal_terms", "Renewal terms"),
    ("payment_terms", "Payment / compensation"),
    ("notice_period", "Notice period"),
    ("termination_conditions", "Termination conditions"),
    ("governing_law", "Governing law"),
    ("jurisdiction", "Jurisdiction"),
    ("confidentiality", "Confidentiality"),
    ("ip_ownership", "IP ownership"),
    ("non_compete", "Non-compete / non-solicitation"),
    ("liability", "Liability"),
    ("indemnification", "Indemnification"),
    ("dispute_resolution", "Dispute resolution"),
)

# Answer texts.
UNGROUNDED_ANSWER = "I couldn't find a specific part of the document that supports a citeable answer to this question."
PARSE_ERROR_ANSWER = "Sorry, I couldn't produce a valid grounded answer for this question."

# What each caller answers without context, without a valid citation, and for unusable output.
ANSWER_TEXTS = {
    "chat": {
        "no_context": "This document has no indexed content to search, so I can't answer that.",
        "ungrounded": "I couldn't find a specific part of the document that supports a citeable answer to this question.",
        "parse_error": "Sorry, I couldn't produce a valid grounded answer for this question.",
    },
    "scenario": {
        "no_context": "This document has no indexed content to search, so I can't analyze that scenario.",
        "ungrounded": "I couldn't find a specific part of the document that governs this scenario.",
        "parse_error": "Sorry, I couldn't produce a valid grounded analysis for this scenario.",
    },
    "cross_document": {
        "no_context": "None of the selected documents have indexed content to search, so I can't answer that.",
        "ungrounded": "I couldn't find a specific part of the selected documents that supports a citeable answer to this question.",
        "parse_error": "Sorry, I couldn't produce a valid grounded answer for this question.",
    },
}
