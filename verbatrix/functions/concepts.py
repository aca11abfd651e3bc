"""Concepts that statements are tagged with."""

from __future__ import annotations

# Patterns of concepts, matched without case.
CONCEPTS = {
    "unpublish": r"\bunpublish(?:ed|es|ing)?\b",
    "deindex": r"\bde-?\s?index(?:ed|es|ing)?\b|\bremov\w* from search(?: engines?| results?)?\b",
    "noindex": r"\bno-?index\b|\bnoarchive\b",
    "anonymize": r"\banonymi[sz](?:e|ed|es|ing|ation)\b|\bremov\w* (?:the |a |their |his |her )?names?\b|\breplac\w* (?:the |a )?names? with\b|\binitials? only\b",
    "remove": r"\b(?:remov(?:e|ed|es|al|ing)|delet(?:e|ed|es|ion|ing)|take(?:n)? down|takedowns?|withdraw(?:n|al)?)\b",
    "redact": r"\bredact(?:ed|ion|ing)?\b",
    "changed_circumstances": r"\bchang(?:e|ed|ing) (?:in )?circumstances?\b|\bcircumstances (?:have |had )?changed\b|\bnew information\b",
    "dismissed_charges": r"\bcharges?\b(?:\s+(?!not\b)[\w.'-]+){0,5}?\s+(?:were |was |are |is |have been |had been |being )?(?:later |ultimately |eventually )?(?:dismissed|dropped|withdrawn|reduced)\b|\bcase (?:was |is |were )?(?:later )?(?:dismissed|dropped)\b|\bdismiss(?:ed|al of) (?:the |all )?charges?\b|\bnolle pros",
    "acquitted": r"\bacquitt(?:ed|al|als)\b|\bfound not guilty\b|\bnot guilty verdict\b",
    "exonerated": r"\bexonerat(?:ed|ion)\b|\bwrongful(?:ly)? convict",
    "vacated": r"\bvacat(?:e|ed|ing)\b(?:.{0,40}\bconvictions?\b)?|\bconvictions? (?:was |were )?(?:overturned|set aside|reversed)\b|\bset aside\b",
    "expunged_sealed": r"\bexpung(?:e|ed|ement|ements)\b|\b(?:records?|case|file)s?\b.{0,30}\bseal(?:ed|ing)\b|\bsealed records?\b",
    "plea_withdrawn": r"\bplea (?:was )?withdrawn\b|\bwithdr[ae]w (?:a |the |his |her |their )?(?:guilty )?plea\b",
    "arrest_record": r"\barrest(?:ed|s)?\b|\bmug ?shots?\b|\bbooking photos?\b|\bpolice (?:blotter|log|report)s?\b|\bcrime log\b",
    "criminal_allegation": r"\b(?:charged with|criminal charges?|accused of|indicted|allegations?|alleged(?:ly)?|suspects?|defendants?)\b",
    "juvenile": r"\b(?:juveniles?|minors?)\b",
    "rehabilitation": r"\brehabilitat(?:e|ed|ion)\b|\bsecond chance\b|\bmoved on\b|\bserved (?:their|his|her) sentence\b",
    "time_passage": r"\b(?:\d{1,2}|several|many|ten|five|seven|twenty) (?:or more )?years? (?:ago|later|old|after|have passed|has passed)\b|\bpassage of time\b|\bdecades? (?:ago|later|old)\b|\byears (?:later|after)\b",
    "reputational_harm": r"\breputation(?:al)?\b|\bemployment prospects\b|\bjob (?:search|prospects|applications?)\b|\bstigma\b|\bharm(?:s|ed|ful)? to (?:a |the )?(?:person|individual|subject)\b",
    "search_engine": r"\bsearch engines?\b|\bgoogle\b|\bsearch results?\b|\bbing\b|\bwhen (?:someone|people|employers) search\b",
    "digital_permanence": r"\bpermanence of (?:publication|the (?:internet|web|archive))\b|\bextended reach\b|\bdigital (?:permanence|footprint|age)\b|\bonline forever\b|\bpermanent(?:ly)? (?:online|available|searchable)\b|\blives? (?:on )?(?:online )?forever\b",
    "right_to_be_forgotten": r"\bright to be forgotten\b|\bright to erasure\b",
    "privacy": r"\bprivacy\b|\bprivate (?:individual|citizen|person|figure)s?\b",
    "safety": r"\b(?:physical )?safety\b|\bthreat(?:s|ened)? of (?:violence|harm)\b|\bdanger\b|\bstalk(?:ing|er)\b|\bdomestic violence\b",
    "minimize_harm": r"\bminimi[sz](?:e|ing) harm\b|\bharm(?:s)? (?:to|caused)\b|\bcompassion\b",
    "public_interest": r"\bpublic interest\b|\bnewsworth(?:y|iness)\b|\bpublic (?:figure|official)s?\b",
    "case_by_case": r"\bcase[- ]by[- ]case\b|\bon an individual basis\b|\beach (?:request|case) (?:is|will be) (?:reviewed|considered|evaluated)\b|\bconsider each (?:request|case) individually\b",
    "discretion": r"\b(?:sole |editorial |editor'?s? |editors'? )discretion\b|\bat the discretion\b",
    "update_note": r"\beditor'?s'? notes?\b|\b(?:update|updated|updating|append(?:ed)?|addend(?:um|a))\b|\bfollow[- ]?up (?:story|coverage|article)\b|\boutcome of the case\b|\bdisposition\b",
    "correction": r"\bcorrect(?:ion|ions|ed|ing)\b|\bclarification\b|\berrors?\b|\binaccura(?:te|cy|cies)\b",
    "archive_integrity": r"\bhistorical record\b|\brecord of (?:history|publication|what happened)\b|\bintegrity of (?:the |our )?(?:archives?|record)\b|\bpermanent (?:archive|record)\b|\bfirst (?:rough )?draft of history\b|\bwe (?:are|serve as) (?:a |the )?record\b",
    "removal_request": r"\brequests? (?:to|for) (?:remove|removal|unpublish|delete|take down|anonymi[sz]e|de-?index)\b|\b(?:removal|takedown|unpublishing) requests?\b|\basked (?:us )?to (?:remove|unpublish|take down|delete)\b",
    "legal_order": r"\bcourt orders?\b|\blegal(?:ly)? (?:required|obligation|reasons?|grounds)\b|\bdefamat(?:ion|ory)\b|\blibel(?:ous)?\b|\bsubpoena\b",
    "canonical_or_sitemap": r"\bcanonical\b|\bsitemaps?\b|\brobots\.txt\b",
}
