"""Fixed values of the rule sets: intents, phrase families and stop lists. Data, to be replaced by configuration."""

from __future__ import annotations

#: Fixed values. Intents in the order that breaks ties, each with the patterns searched in normalised text.
INTENTS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("software_update_os", (r"\bios\b", r"\bmacos\b", r"\bhigh sierra\b", r"\bsoftware update", r"\bupdate[ds]?\b", r"\bupgrade[ds]?\b", r"\bbeta\b",)),
    ("battery_power_charging", (r"\bbattery\b", r"\bcharg(?:e|ing|er)\b", r"\bpower\b", r"\bshut ?down\b", r"\bturn(?:ed)? off\b", r"\bwon'?t turn on\b",)),
    ("connectivity_network", (r"\bwi[ -]?fi\b", r"\bbluetooth\b", r"\bcellular\b", r"\bnetwork\b", r"\bhotspot\b", r"\bsignal\b", r"\b4g\b", r"\blte\b",)),
    ("apple_id_icloud_account", (r"\bapple id\b", r"\bicloud\b", r"\bsign[ -]?in\b", r"\bpassword\b", r"\baccount\b", r"\bverification\b", r"\btwo[ -]?factor\b",)),
    ("app_store_media_services", (r"\bapp store\b", r"\bitunes\b", r"\bapple music\b", r"\bmusic\b", r"\bpodcast\b", r"\bdownload(?:ing|ed)?\b", r"\blibrary\b",)),
    ("billing_purchases_subscriptions", (r"\bcharged\b", r"\bcharge(?: me| my| for)\b", r"\bbill(?:ing|ed)?\b", r"\bpayment\b", r"\bpurchase[ds]?\b", r"\brefund\b", r"\bsubscription\b", r"\bcredit card\b", r"\bmoney\b",)),
    ("messaging_calls_facetime", (r"\bimessage\b", r"\bface ?time\b", r"\bsms\b", r"\btext(?:ing|s)?\b", r"\b(?:send|sent|receive|received|deliver(?:ed|y)?)\s+(?:a )?messages?\b", r"\bmessages?\s+(?:not|won|doesn|aren|isn't|are not|can't)\b", r"\bcalls?\b",)),
    ("hardware_accessories", (r"\bscreen\b", r"\bcamera\b", r"\bspeaker\b", r"\bheadphones?\b", r"\bhome button\b", r"\btouch id\b", r"\blightning\b", r"\bcable\b", r"\bport\b", r"\bmicrophone\b",)),
    ("device_setup_activation_migration", (r"\bactivat(?:e|ion|ed)\b", r"\bset ?up\b", r"\brestore\b", r"\btransfer\b", r"\bmigrat(?:e|ion)\b", r"\bnew (?:iphone|ipad|phone)\b", r"\breplacement\b",)),
    ("mac_computer", (r"\bmacbook\b", r"\bimac\b", r"\bmac\b", r"\bmac mini\b",)),
    ("apple_watch", (r"\bapple watch\b", r"\bwatchos\b", r"\bmy watch\b",)),
    ("performance_stability", (r"\bslow\b", r"\bfreez(?:e|ing|es|en)\b", r"\bcrash(?:es|ed|ing)?\b", r"\blag(?:gy)?\b", r"\bglitch\b", r"\bstuck\b", r"\bnot working\b", r"\bdoesn'?t work\b",)),
    ("keyboard_text_rendering", (r"\bquestions? marks?\b", r"\bsquares?\b", r"\bkeyboard\b", r"\bletters?\b", r"\bcharacters?\b", r"\bemojis?\b", r"\btext rendering\b",)),
    ("support_contact_experience", (r"\bcustomer service\b", r"\bon hold\b", r"\bdisconnected\b", r"\bprivate messages?\b", r"\bcheck dm\b", r"\bwaiting\b", r"\bsupport (?:is|was|has)\b",)),
    ("store_orders_repairs", (r"\bapple store\b", r"\brepair\b", r"\bgenius bar\b", r"\border\b", r"\bdeliver(?:y|ed)?\b", r"\bship(?:ping|ped)?\b", r"\bappointment\b",)),
)

#: Fixed values. Words left out of topical tokens.
BRAND_STOP_WORDS = (
    "the", "and", "that", "this", "with", "for", "you", "your", "are", "was", "have", "has", "not", "but", "from",
    "can", "will", "just", "please", "help", "thanks", "thank", "http", "https", "com", "www", "get", "got", "its",
    "into", "about", "they", "their", "our", "out", "all", "been", "need", "want", "could", "would", "should", "when",
)

#: Fixed values. Words left out of sampling, retrieval and evidence tokens.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "when", "while", "for", "with", "without", "this", "that",
    "these", "those", "from", "into", "onto", "over", "under", "about", "after", "before", "between", "through",
    "during", "because", "please", "help", "my", "your", "our", "i", "me", "you", "we", "they", "them", "is", "are",
    "was", "were", "be", "been", "being", "to", "of", "in", "on", "at", "it", "its", "as", "so", "not", "no", "yes",
    "can", "could", "would", "should", "have", "has", "had", "do", "does", "did", "im", "apple", "support", "thanks",
    "thank", "hi", "hello", "issue", "problem", "fix", "bug", "app", "apps", "phone", "iphone", "ipad", "watch",
    "just", "very", "really", "too", "also", "still", "again", "out", "up", "down", "all", "any", "some", "few",
    "many", "more", "most", "ever",
)

#: Fixed values. The shorter list of the review step.
REVIEW_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "when", "while", "for", "with", "this", "that", "from",
    "about", "please", "help", "my", "your", "our", "i", "me", "you", "we", "they", "is", "are", "was", "were", "to",
    "of", "in", "on", "at", "it", "as", "so", "not", "no", "yes", "can", "could", "would", "should", "have", "has",
    "had", "do", "does", "did", "im", "apple", "support", "issue", "problem", "fix", "app", "apps", "phone", "just",
    "very", "really", "too", "also", "still", "again", "all", "any", "some", "more",
)

#: Fixed values. Reasons to escalate at annotation, all kept, with their phrases.
ANNOTATION_RISKS = (
    ("financial loss, refund, or disputed charge", r"\b(?:refund|charged|charge|billing|payment|subscription|credit card|money)\b"),
    ("account access or security concern", r"\b(?:stolen|verification|password|disabled|hack|security|account recovery)\b"),
    ("repair, warranty, store, or appointment issue", r"\b(?:repair|warranty|genius bar|appointment|store|replacement)\b"),
    ("explicit complaint or manager request", r"\b(?:manager|complaint|customer service|employee|legal|lawsuit)\b"),
    ("safety or emergency indicator", r"\b(?:911|fire|smoke|overheat|overheating|danger|safety)\b"),
)

#: Fixed values. Risks that always escalate, first hit names the reason.
DECISION_RISKS = (
    ("account_or_security_sensitive", r"\b(?:password|passcode|security|locked out|account recovery|apple id|icloud account|verification code|two[- ]factor|2fa|stolen|lost (?:my )?(?:iphone|ipad|mac)|find my)\b"),
    ("billing_or_payment_case_specific", r"\b(?:charged|charge|refund|refund me|payment|billing|credit card|debit card|purchase|subscription|unauthorized purchase|unknown purchase|money)\b"),
    ("order_repair_case_specific", r"\b(?:order|repair|replacement|replace my|service appointment|genius bar|shipment|shipping|delivery|return my|warranty claim)\b"),
)

#: Fixed values. Response types by their phrases, the first that fits.
RESPONSE_TYPES = (
    ("diagnostic_question", r"\?|\b(?:what happens|which app|what version|how often|does it continue|are you using|have you tried|is this happening)\b"),
    ("direct_guidance", r"\b(?:go to|open|tap|select|choose|update|restart|reset|enable|disable|install|contact|use this link|here(?:'|’)s how)\b"),
    ("generic_routing", r"\b(?:dm|direct message|look into this|continue from there|continue looking|let us know|we(?:'|’)d be happy to help|we(?:'|’)d like to look into)\b"),
)
GENERIC_GOLD_RESPONSE = r"(?:dm|direct message|look into this|continue looking|continue in|thanks for letting us know|let us know|we'?d like to look into)"
NON_SUPPORT = r"(?:thanks?|thank you|love (?:it|you)|great|awesome|good morning|hello|hi|hey)[! .😊❤️👍]*"

#: Fixed values. Difficulty tags that are phrases.
DIFFICULTY_PHRASES = (
    ("troubleshooting_request", r"\b(?:how|why|can|could|help|won'?t|doesn'?t|not working|unable|stuck|fix)\b"),
    ("complaint_or_frustration", r"\b(?:annoyed|frustrat|angry|hate|seriously|bullshit|ridiculous|upset|disappointed|wtf|damn)\b|!{1,}"),
    ("possible_escalation_context", r"\b(?:employee|refund|charged|billing|lawsuit|manager|repair|appointment|store|customer service|escalat)\b"),
    ("historical_retrieval_context", r"\b(?:already|again|still|tried|before|past|previous|every time|keeps?)\b"),
    ("question_or_missing_detail", r"\b(?:what|which|where|when|who)\b|\?"),
)

#: Fixed values. Characters and clusters of wrongly decoded text.
MOJIBAKE_MARKERS = "ï¿¸âÃÂãðÐþÞýÝ"
MOJIBAKE_CLUSTERS = r"(?i)(?:ï¿|ï¸|Ã¢|Ã©|Ã±|Ã¼|â€™|ðŸ)"

#: Fixed values. Sizes of the golden set's strata and the seed of their order.
GOLDEN_SEED = 20260912
SAMPLE_SEED = 20260913
BUCKET_QUOTAS = (("primary_intent", 150), ("unclassified", 20), ("multi_intent", 15), ("ambiguous", 15))

#: Fixed values. Sizes of the golden set's intents, in the order in which they are filled.
INTENT_QUOTAS = (
    ("app_store_media_services", 10), ("apple_id_icloud_account", 9), ("apple_watch", 6), ("battery_power_charging", 10), ("billing_purchases_subscriptions", 8),
    ("connectivity_network", 9), ("device_setup_activation_migration", 9), ("hardware_accessories", 10), ("keyboard_text_rendering", 10), ("mac_computer", 8),
    ("messaging_calls_facetime", 10), ("performance_stability", 10), ("software_update_os", 26), ("store_orders_repairs", 8), ("support_contact_experience", 7),
)
#: Fixed values. Sizes of the candidate pool.
POOL_SIZES = (("primary_intent", 520), ("unclassified", 60), ("multi_intent", 80), ("ambiguous", 40))
