"""Patterns and word lists that decide results, in Java's spelling."""

from __future__ import annotations

# manuscript grammar
ATX_HEADING = r"^( {0,3})(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"
SETEXT_HEADING = r"^ {0,3}(=+|-+)[ \t]*$"
FENCE = r"^ {0,3}(`{3,}|~{3,})"
DELIMITER_CELL = r"^:?-{3,}:?$"
NUMBER = r"(?<![\p{L}\p{N}_.])[+\-−]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)(?:[eE][+\-]?\d+)?(?:\s*%|(?!\s*%))(?![\p{L}\p{N}_])"
LOOSE_SENTENCE = r"[^.!?]+[.!?]?"

# hidden content
HTML_COMMENT = r"(?s)<!--.*?-->"
HIDDEN_STYLE = (
    r"(?i)(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\D|$)|font-size\s*:\s*0(?:px|pt|em|rem|%)?"
    r"|color\s*:\s*(?:white|#fff(?:fff)?|rgba?\(\s*255\s*,\s*255\s*,\s*255))"
)
INSTRUCTIONS = (
    r"(?i)\bignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?\b",
    r"(?i)\b(?:give|assign|award)\s+(?:this\s+paper\s+)?(?:a\s+)?high\s+score\b",
    r"(?i)\b(?:reviewer|reviewers|review\s+agent)\s*[:,]\s*(?:must\s+)?(?:accept|approve|recommend\s+acceptance)\b",
    r"(?i)\b(?:you|reviewer|reviewers)\s+must\s+(?:accept|approve|give|assign|ignore)\b",
    r"(?i)\b(?:do\s+not|never)\s+(?:report|mention|flag|disclose)\s+(?:this|the\s+instruction|the\s+attack)\b",
)

# claims
ARITHMETIC = r"(?i)\b(?:delta|difference|relative|percentage|percent)\s+(?:improvement|change)|\b(?:absolute\s+)?delta\b"
RESULT = (
    r"(?i)\b(?:achiev(?:e|es|ed)|attain(?:s|ed)?|obtain(?:s|ed)?|reach(?:es|ed)?|record(?:s|ed)?|report(?:s|ed)?|scor(?:e|es|ed)|result(?:s|ed)?|yield(?:s|ed)?"
    r"|establish(?:es|ed)?|improv(?:e|es|ed|ement)|reduc(?:e|es|ed|tion)|outperform(?:s|ed)?|surpass(?:es|ed)?|measured|observed|mean|median|average|comparison|experiment|run)\b"
)
STATE_OF_THE_ART = r"(?i)state[-\s]of[-\s]the[-\s]art|\bSOTA\b"
REFERENCE_SECTION = r"(?i)\b(?:references|bibliography|works?\s+cited)\b"
CITATION_ONLY = r"^\[[^\]]+\]\([^)]+\)[.,;]?$"
CITATION_MARK = r"(?:\[[^\]]+\]|\b(?:arXiv:)?\d{4}\.\d{4,5}(?:v\d+)?\b)"
CHECKBOX_ITEM = r"^\s*[-*+]\s*\[[ xX]\]\s*"
LIST_PREFIX = r"^\s*(?:[-*+]\s+|\d+[.)]\s+)"
HEADING_LINE = r"^\s{0,3}#{1,6}\s+"
DELIMITER_LINE = r"^\s*\|?\s*:?-{3,}:?(?:\s*\|\s*:?-{3,}:?)+\s*\|?\s*$"
CLAIM_SENTENCE = r"\S(?:.*?\S)?(?:[.!?](?=\s|$)|$)"

# metrics and ledgers
DEFAULT_METRICS = "val_bpb score accuracy loss perplexity mfu_percent peak_vram_mb elapsed_seconds training_seconds total_seconds num_params_M total_tokens_M".split()
DERIVED_LABELS = "delta improvement change difference".split()
NON_RESULT_FIELDS = "gpu_count seed depth num_steps".split()
NON_RESULT_CONTEXT = r"(?i)\b(?:hypothesis|threshold|target|budget|planned|expected|seed|at least|at most)\b"
RESULT_LANGUAGE = r"(?i)\b(?:achieved|attained|found|measured|observed|obtained|reached|recorded|reports?|resulted|scored|was|were|mean|median|average[sd]?)\b"
RESULT_SECTION = r"(?i)\b(?:experiment|evaluation|finding|result)s?\b"
LOWER_IS_BETTER = "val_bpb loss perplexity elapsed_seconds training_seconds total_seconds peak_vram_mb".split()
HIGHER_IS_BETTER = "score accuracy mfu_percent".split()
ARITHMETIC_CLAIM = (
    r"(?i)\b(absolute\s+delta|delta|difference|relative\s+improvement|percentage\s+improvement|percent\s+improvement|improvement|relative\s+change|percentage\s+change|percent\s+change)\b"
    r"[^\n.!?;]{0,48}?(?:is|was|of|=|:)\s*([+\-−]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:[eE][+\-]?\d+)?\s*%?)"
)
FROM_TO = (
    r"(?i)\bfrom\s+(\d[\d,]*(?:\.\d+)?)\s*%?\s+to\s+(\d[\d,]*(?:\.\d+)?)\s*%?[^.!?\n]{0,80}?"
    r"\b(?:relative\s+|percentage\s+|percent\s+)?(gain|improvement|increase|reduction|decrease|drop|change)\s+of\s+(\d[\d,]*(?:\.\d+)?)\s*%"
)
IMPROVEMENT = r"(?i)\b(?:improv(?:e[ds]?|ing|ement)|outperform(?:s|ed|ing)?|surpass(?:es|ed|ing)?|beat(?:s|en|ing)?|better\s+than|(?:lower|higher)\s+than)\b"
NON_CLAIM = r"(?i)\b(?:aim(?:s|ed)?\s+to|could|expected|future|goal|hope(?:s|d)?\s+to|hypothes(?:is|ize[ds]?)|might|plan(?:s|ned)?\s+to|potential|would)\b"
NEGATED_IMPROVEMENT = r"(?i)\b(?:did\s+not|does\s+not|do\s+not|no|not|never|without)\b[^.!?]{0,24}\b(?:improv|outperform|surpass|beat|better|lower|higher)"
BOUNDED_IMPROVEMENT = r"(?i)\b(?:relative\s+|percentage\s+|percent\s+)?improvement\s+(?:is|was|of|=|:)\s*[+\-−]?(?:\d+(?:\.\d+)?|\.\d+)\s*%?"
BASELINE_REFERENCE = r"(?i)\bbaseline\b|\b(?:compared\s+(?:to|with)|relative\s+to|versus|vs\.?)\s+(?:the\s+)?[A-Za-z][\w.-]*"
CONFIRMATION = r"(?i)\b(?:confirm(?:ation|atory|ed)?|re[-_ ]?run|repeat(?:ed)?)\b"
FAILED_STATUSES = "cancel cancelled crash discard error fail failed".split()
NON_METRIC_FIELDS = "gpu_count seed step steps num_steps run run_id trial status timestamp".split()
NEGATIVE_STATUSES = "discard crash".split()
IDENTITY_FIELDS = "trial run_tag job_slug job_name name id".split()
NEGATIVE_LANGUAGE = r"(?i)\b(?:discard(?:ed)?|crash(?:ed)?|fail(?:ed|ure)?|abort(?:ed)?|exclude(?:d)?|error|invalid|inconclusive|unsuccessful)\b"
SEED_FIELDS = "seed random_seed rng_seed".split()
GPU_FIELDS = "gpu gpu_type gpu_model accelerator accelerator_type device device_type".split()
BENCHMARK_FIELDS = "benchmark benchmark_name dataset dataset_name task task_name suite".split()
METRIC_CONTAINERS = "metric metrics result results score scores".split()
SCOPE_NON_METRICS = (
    "trial run run_id run_name run_tag role name seed random_seed rng_seed gpu gpu_type gpu_model accelerator accelerator_type device device_type benchmark benchmark_name dataset dataset_name "
    "task task_name suite metric metric_name measure measure_name batch_size duration elapsed_seconds epoch epochs gpu_count learning_rate lr num_steps status step steps timestamp tokens total_tokens"
).split()
GENERALIZED = (
    r"(?i)\b(?:generaliz(?:e[sd]?|able|ation)|broadly\s+(?:applicable|effective)|universal(?:ly)?|robust\s+across|consistently\s+(?:outperform|improv|perform)"
    r"|(?:across|on)\s+(?:all|every|multiple|several|diverse|a\s+wide\s+range\s+of)\s+(?:benchmarks?|datasets?|tasks?|domains?|metrics?|seeds?|runs?|gpus?|gpu\s+types?|hardware|accelerators?))\b"
)
NON_ASSERTION = r"(?i)\b(?:aim(?:s|ed)?\s+to|could|future|hope(?:s|d)?\s+to|hypothes(?:is|ize[ds]?)|might|plan(?:s|ned)?\s+to|potentially|would)\b"
NEGATED_SCOPE = r"(?i)\b(?:does?|did|is|are|was|were|may|might|can|could|will|would)\s+not\b[^.!?]{0,40}\b(?:generaliz|robust|consistent|universal)"
_DIMENSION = r"(benchmarks?|datasets?|tasks?|domains?|metrics?|seeds?|runs?|trials?|gpus?|gpu\s+types?|hardware|accelerators?)"
COUNTED_SCOPE = rf"(?i)\b(?:across|on)\s+(\d+)\s+{_DIMENSION}\b"
QUALIFIED_SCOPE = rf"(?i)\b(?:across|on)\s+(all|every|multiple|several|diverse|a\s+wide\s+range\s+of)\s+{_DIMENSION}\b"
BARE_SCOPE = rf"(?i)\b(?:generaliz(?:e[sd]?|able|ation)|robust)\s+(?:well\s+)?across\s+{_DIMENSION}\b"

# citations
ARXIV = r"(?i)(?:arxiv\s*:\s*|arxiv\.org/(?:abs|pdf)/)((?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?)"
BRACKET_ARXIV = r"(?i)\[(?:arxiv\s*:\s*)?(\d{2}(?:0[1-9]|1[0-2])\.\d{4,5}(?:v\d+)?)\]"
S2_URL = r"(?i)semanticscholar\.org/paper/(?:[^\s/)]+/)?([0-9a-f]{40}|CorpusId:\d+)"
CORPUS_ID = r"(?i)\bCorpusId\s*:\s*(\d+)\b"
DOI = r"(?i)(?:doi\s*:\s*|doi\.org/)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
GENERIC_LABELS = ("arxiv", "doi", "link", "paper", "pdf", "semantic scholar", "source")
REGISTRY_MARK = r"\[([a-z]+:\d{2}\.\d{5})\]"
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
GENERIC_LABELS = ("arxiv", "doi", "link", "paper", "pdf", "semantic scholar", "source")
NUMERIC_CITE = r"\[\d{1,4}(?:\s*[,–-]\s*\d{1,4})*\]"

# template and integrity
CORE_SECTIONS = {
    "Research Spec": r"(?i)\bresearch spec\b",
    "Short Paper": r"(?i)\bshort paper\b",
    "Abstract": r"(?i)\babstract\b",
    "Experiments and Results": r"(?i)\bexperiments?\b.*\bresults?\b|\bresults?\b",
    "Limitations and Conclusion": r"(?i)\blimitations?\b|\bconclusion\b",
    "Self-Review": r"(?i)\bself[- ]review\b",
}
OFFICIAL_MARKER = r"(?i)Track\s*1\s*[—:-]\s*AI Scientist Submission"
WRAPPER_SECTION = r"(?i)\bagent workflow\b"
PAGE_COUNT = r"(?i)(?:page count|pages?)\s*[:=]\s*(\d+)\b"
ANY_CHECKBOX = r"^\s*[-*+]\s+\[([^\]])\]\s+(.+)$"
LEADING_CHECKBOX = r"^\s*[-*+]\s+\[([ xX])\]\s+(.+?)\s*$"
TRAILING_CHECKBOX = r"^\s*[-*+]\s+(.+?)\s*:?\s*\[([ xX])\]\s*$"
SELF_REVIEW_TITLE = r"(?i)self[- ]review"
ITEM_FAMILIES = (
    (r"(?i)\b(?:number|trace|traces|evidence|ledger)\b", ("ledger-trace",)),
    (r"(?i)\bbaselines?\b|\bfair\b|\bmetric\b", ("baseline-fairness",)),
    (r"(?i)\bclaims?\b.*\bresults?\b|\bresults?\b.*\bclaims?\b|\bmatch\b", ("internal-consistency", "arithmetic")),
    (r"(?i)\bnegative\b|\binconclusive\b", ("negative-evidence",)),
    (r"(?i)\bcitations?\b", ("citation-existence",)),
    (r"(?i)\bpage count\b|\bpages?\b", ("template-compliance",)),
)
BROKEN_REFERENCES = (
    ("float reference", r"(?i)\b(?:figure|fig|table|tbl|section|sec|equation|eq|algorithm|alg|appendix|listing)\.?\s*\?\?"),
    ("undefined reference", r"(?i)\bundefined (?:reference|control sequence|citation)\b"),
    ("unrendered reference", r"\\(?:ref|eqref|autoref|cref|Cref)\s*\{[^}]*\}"),
    ("failed citation", r"\[\s*\?\s*\]"),
    ("garbled reference", r"\bef[a-z]{2,}:[a-z]+\b"),
)
ARTIFACT = r"\bAUTHORERR\b|\\author\s*\{\s*\}|(?<![\w-])(?:TODO|FIXME|TBD|PLACEHOLDER)(?![\w-])|(?i:\[citation needed\])|(?i:\blorem ipsum\b)"
PROMISE = (
    r"(?i)\b(?:held[- ]?out|hold[- ]?out)\b|\bunseen\s+(?:transfer|test|evaluation|scenario)\b"
    r"|\bwe\s+(?:additionally|also|further)\s+(?:report|evaluate|measure|collect)\b|\breported?\s+(?:below|in\s+section|in\s+appendix)\b"
)
REFERENCES_HEADING = r"(?i)^#{1,6}\s*(?:references|bibliography)\b"
PROMISE_STOPWORDS = (
    "about above after again their there these those which while whose being under between through during against without within because should would could where every other another "
    "paper section appendix figure table results result experiment experiments evaluation scenario transfer unseen held holdout"
).split()
RIGOR_CHECKLIST = {
    "release": (
        r"(?i)\b(?:code|implementation|dataset|data|weights?|checkpoints?)\s+(?:is|are|will\s+be)\s+(?:made\s+)?(?:available|released|public|open)"
        r"|github\.com|hugging\s*face|zenodo|\bwe\s+(?:release|open[- ]?source|provide|share|make\s+available)\b|supplementary\s+material|reproducib"
    ),
    "hyperparameters": r"(?i)\bhyper[- ]?parameters?\b|learning\s+rate|batch\s+size|\boptimizer\b|weight\s+decay|(?:number\s+of\s+)?epochs?\b|warm[- ]?up|\bAdam\b|\bSGD\b",
    "hardware": r"(?i)\bGPUs?\b|\bTPUs?\b|\bA100\b|\bV100\b|\bH100\b|GPU[- ]hours?|compute\s+(?:budget|cost|resources)|\bhardware\b|\bFLOPs?\b|\bcores?\b",
    "limitations": r"(?i)\blimitations?\b|\bshortcomings?\b|\bfailure\s+cases?\b",
    "impact": r"(?i)broader\s+impact|societal\s+impact|ethic|potential\s+(?:harm|misuse|negative\s+impact)|responsible\s+(?:use|ai)",
}
RELATED_WORK_TITLE = r"(?i)\b(?:related\s+work|prior\s+work|previous\s+work|background|literature\s+review|references|bibliography)\b"
NOVELTY = (
    r"(?i)\b(?:we\s+(?:are|were)\s+the\s+first\b|(?:is|are)\s+the\s+first\s+(?:method|approach|work|paper|model|system|framework|algorithm|technique)\s+to\b|for\s+the\s+first\s+time\b"
    r"|to\s+(?:the\s+)?best\s+of\s+our\s+knowledge\b|(?:new\s+)?state[-\s]of[-\s]the[-\s]art\b|\bSOTA\b|best[-\s]performing\b|advanc(?:e|es|ing)\s+the\s+state\b"
    r"|(?:we\s+(?:propose|present|introduce|develop|design|devise|offer)|our)\s+(?:[a-z]+[\s,]+){0,4}?(?:novel|new)\s+(?:method|approach|framework|architecture|algorithm|technique|model|network|module|paradigm|formulation|objective|loss|scheme)"
    r"|(?:a|the|this)\s+(?:novel|new)\s+(?:method|approach|framework|architecture|algorithm|technique|model|network|module|paradigm|formulation)\s+(?:that|which|for|to|is|we|,))"
)
SUPERIORITY = (
    r"(?i)\b(?:outperform(?:s|ed|ing)?|surpass(?:es|ed|ing)?|beat(?:s|en|ing)?|exceed(?:s|ed|ing)?|superior|better)\b[^.!?]{0,48}?\b(?:baselines?|state[-\s]of[-\s]the[-\s]art|sota|prior|previous|existing"
    r"|competing|other\s+(?:methods?|models?|systems?|approaches|networks?)|all\s+(?:[a-z]+\s+){0,3}?(?:methods?|models?|systems?|approaches|baselines?|networks?))\b"
)
LOOSE_SUPERIORITY = (
    r"(?i)\b(?:we|our\s+(?:method|approach|model|system|framework|technique|algorithm|results?|work))\b[^.!?]{0,32}?"
    r"\b(?:outperform(?:s|ed|ing)?|surpass(?:es|ed|ing)?|(?:is|are)\s+superior\s+to|(?:is|are|performs?|do(?:es)?)\s+better\s+than)\b"
)
HYPOTHETICAL_CLAIM = (
    r"(?i)\b(?:plan(?:s|ned)?|aim(?:s|ed)?|hope(?:s|d)?|intend(?:s|ed)?|expect(?:s|ed)?|seek(?:s)?|going|will|would|could|might|may|shall)\s+to\s+(?:[a-z]+\s+){0,2}?"
    r"\b(?:outperform\w*|surpass\w*|beat\w*|exceed\w*|be\s+(?:novel|superior|the\s+first)|achiev\w*\s+state|propose|present|introduce)\b"
)
COMPARATOR = r"(?i)\bbaselines?\b|\b(?:compared\s+(?:to|with)|relative\s+to|versus|vs\.?|against)\s+(?:the\s+)?[A-Za-z][\w.-]*"
AUTHOR_YEAR = (
    r"[\(\[][A-Z][A-Za-z.'’-]+(?:\s+(?:et\s+al\.?|and|&|[A-Z][A-Za-z.'’-]+))*,?\s+(?:18|19|20)\d{2}[a-z]?[\)\]]"
    r"|[A-Z][A-Za-z.'’-]+\s+et\s+al\.?\s*\((?:18|19|20)\d{2}[a-z]?\)|\[[A-Z][A-Za-z]+(?:etal)?\d{2,4}[a-z]?\]"
)
NEGATED_CLAIM = r"(?i)\b(?:not|never|n't|no\s+longer|do(?:es)?\s+not|did\s+not)\s+(?:[a-z]+\s+){0,2}?\b(?:novel|state[-\s]of[-\s]the[-\s]art|sota|outperform\w*|surpass\w*|beat\w*|exceed\w*|superior|better\s+than|first\s+to)\b"
VARIANCE = r"(?i)\b(?:variance|std(?:ev|\.)?|standard[- ]deviation|confidence[- ]interval|error[- ]bars?|seeds?|stderr|averaged|deviation|±)\b|\b\d+\s+(?:runs?|seeds?|trials?)\b|\bmultiple\s+(?:runs?|seeds?|trials?)\b"

# retrieval
TOPIC_WORD = r"[a-z][a-z0-9+/-]{2,}"
TOPIC_STOPWORDS = (
    "a an and are as at be by for from has have in into is it its of on or that the their this to via we with our using use used based toward towards over under between across can could may "
    "might will would than then them they these those also more most much such other another paper method approach model results show shows shown propose proposed present presented new novel study work"
).split()

# page extraction clean-up
PICTURE_TEXT = r"(?s)[ \t]*<!-- Start of picture text -->.*?<!-- End of picture text -->[ \t]*(?:\n|$)"
BOILERPLATE = r"(?i)(?:grants permission to reproduce|permission to make digital or hard copies|^\s*copyright\b|^\s*\(c\)\s*\d{4}|^\s*©\s*\d{4})"
NUMERIC_EMPHASIS = r"(?<=\d)\s*[_*]+\s*([.,/·])\s*[_*]+\s*(?=\d)"
MARGIN_ANY = r"(?<![\d.])\d{3}(?![\d.])"
META_LINE = r"(?im)^[ \t]*(?:reviewer|meta[- ]?review(?:er)?|area[- ]?chair)[ \t]*[:#\-][^\n]*(?:\n|$)"
META_PHRASE = (
    r"(?i)\b(?:as (?:an? )?(?:ai|language model|automated reviewer|reviewing agent|assistant|agent)|in this (?:review|batch|pipeline|assessment)"
    r"|(?:this|the) (?:batch|pipeline|reviewing agent|automated (?:reviewer|system)|committee))\b[,:]?"
)
STANCE = (
    r"(?i)\bin (?:my|our) (?:view|opinion|assessment|judg(?:e)?ment)\b,?[ \t]*",
    r"(?i)\b(?:I|we) (?:believe|think|feel|find|note|observe|argue|would argue|suspect|conclude|assess|recommend|suggest) that ",
)
INTENSIFIER = (
    r"(?i)\b(?:unusually|remarkably|notably|exceptionally|extraordinarily|truly|genuinely|particularly|highly|incredibly|impressively|strikingly|surprisingly|refreshingly|exceedingly|immensely|tremendously|especially)[ \t]+"
)
FLOURISH = (
    (r"(?i)\bthe strongest part\b", "a strength"),
    (r"(?i)\b(?:exemplary|impressive|compelling|elegant|masterful|stellar|superb|outstanding|remarkable|striking)[ \t]+", ""),
)

# reviews
REVIEW_TITLE = r"(?im)^#\s*Review(?:\s+of)?:?\s*(.+?)\s*$"
