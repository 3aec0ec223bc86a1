"""Word lists, abbreviations and mappings that must equal the reference's for
equal results. They are data; every function that uses one takes it as a parameter."""

STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "at", "for", "to", "and", "or", "what", "how", "when",
    "where", "which", "who", "does", "do", "can", "should", "would", "could",
]
MORE_STOP_WORDS = [*STOP_WORDS, "according", "with", "from"]

# In this order: a replacement sees the result of those before it.
ACRONYMS = [
    ("AAP", "American Academy of Pediatrics"),
    ("DSM-5", "Diagnostic and Statistical Manual of Mental Disorders 5th edition"),
    ("DSM5", "Diagnostic and Statistical Manual of Mental Disorders 5th edition"),
    ("M-CHAT", "Modified Checklist for Autism in Toddlers"),
    ("M-CHAT-R/F", "Modified Checklist for Autism in Toddlers Revised with Follow-up"),
    ("ASD", "Autism Spectrum Disorder"),
    ("NICE", "National Institute for Health and Care Excellence"),
    ("FDA", "Food and Drug Administration"),
    ("WHO", "World Health Organization"),
    ("ABA", "Applied Behavior Analysis"),
    ("CBT", "Cognitive Behavioral Therapy"),
    ("ADHD", "Attention Deficit Hyperactivity Disorder"),
    ("GI", "gastrointestinal"),
    ("OAS", "occupational therapy"),
    ("SLP", "speech language pathology"),
    ("IEP", "Individualized Education Program"),
    ("CAMHS", "Child and Adolescent Mental Health Services"),
    ("PGT-A", "preimplantation genetic testing for aneuploidy"),
]

SYNONYMS = [
    ("wait time", "waiting time assessment referral"),
    ("screening", "detection identification assessment"),
    ("medications", "drugs pharmacological treatment"),
    ("treatment", "intervention therapy management"),
    ("diagnosis", "diagnostic assessment evaluation"),
    ("severity", "levels support needs classification"),
    ("domains", "categories areas criteria"),
    ("disciplines", "professionals multidisciplinary team"),
    ("eye-tracking", "eye tracking gaze visual biomarker"),
    ("core", "primary main essential"),
    ("symptoms", "signs features characteristics"),
    ("maximum", "longest upper limit"),
    ("irritability", "aggression self-injury challenging behavior"),
]

PHRASES = [
    "nice cg128", "dsm-5", "m-chat", "eye-tracking", "risperidone", "aripiprazole", "severity level", "social communication",
    "fda approved", "wait time", "screening", "repetitive",
]

KEYWORD_TERMS = ["nice", "cg128", "dsm", "fda", "aap", "cdc", "who", "m-chat", "eye-tracking", "risperidone", "aripiprazole", "aba", "eibi"]

# The first keyword found in a section title gives its factor.
SECTION_KEYWORDS = [
    ("diagnostic criteria", 1.4), ("severity level", 1.4), ("severity classification", 1.4), ("symptom domain", 1.3),
    ("core symptom", 1.3), ("social communication", 1.3), ("eye-tracking", 1.5), ("eye tracking", 1.5), ("visual biomarker", 1.5),
    ("gaze", 1.3), ("screening", 1.2), ("detection", 1.2), ("treatment", 1.2), ("intervention", 1.2), ("medication", 1.2),
    ("dsm-5", 1.3), ("dsm 5", 1.3), ("dsm5", 1.3),
]

DISCLAIMER_MARKS = ["disclaimer", "not a substitute", "clinical decision", "professional medical"]
CLAIM_DISCLAIMER_MARKS = [*DISCLAIMER_MARKS, "general guideline"]

# Arabic letters, digits and punctuation, and what each is folded to.
ARABIC_FROM = "آأإٱٲٳىیکگ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹،؛؟«»"
ARABIC_TO = "ااااااييكغ01234567890123456789,;?\"\""
TASHKEEL = ["064B-065F", "0670", "06D6-06DC", "06DF-06E4", "06E7", "06E8", "06EA-06ED"]
ARABIC_BLOCKS = ["0600-06FF", "0750-077F", "08A0-08FF"]

# Words of questions that are out of scope, and those the streamed answer adds.
OFF_TOPIC = ["restaurant", "weather", "football", "soccer", "world cup", "finance", "stock", "recipe", "travel", "hotel", "movie", "music"]
MORE_OFF_TOPIC = [*OFF_TOPIC, "fashion", "cooking", "gym", "salary"]
SCOPE_LEVELS = ["ALLOWED", "NEEDS_CAUTION", "REFUSE"]

# Parts of document names that tell the kind of a source, in the order in which they are tried.
OFFICIAL = ["peds", "nice", "dsm5", "who_", "cdc_", "fda"]
PEER_REVIEWED = ["eye-tracking", "metaanalysis", "antshel", "fpsyt"]

# What an image reader leaves in a text, and in an answer (with what must be there for a pattern to match).
IMAGE_MARKS = [r"!\[.*?\]\([^)]*\)", r"(?i)image\.png|image\.jpg|image\.jpeg|figure\.png|fig\.png", r"(?i)<img[^>]*>", r"(?i)ERROR:\s*Cannot read.*?Inform the user\.\s*"]
READER_ERRORS = [
    ("cannot read", r'(?i)ERROR:\s*Cannot read ".*?"\s*\(.*?model does not support image input.*?\)[^\n]*'),
    ("cannot read", r"(?i)[^\n]*Cannot read[^\n]*image[^\n]*\n?"),
    ("this model does not support image input", r"(?i)[^\n]*This model does not support image input[^\n]*\n?"),
    ("inform the user.", r"(?i)Inform the user\.[^\n]*"),
]
# The vowel marks that the older Arabic normalizer removes besides ``TASHKEEL``, and the letters it folds.
MORE_TASHKEEL = ["0610-061A"]
LEGACY_FROM = "أإآٱىی٠١٢٣٤٥٦٧٨٩،؛؟"
LEGACY_TO = "اااايي0123456789,;?"
