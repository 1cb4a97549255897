"""Word lists, thresholds and patterns that decide results.

Everything here is data. Changing a value changes what the jobs return.
"""

# ---- fixed values: character classes (Java regex syntax) ----
CJK = "\u4e00-\u9fff"
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
TOKEN = f"([{CJK}]|[a-zA-Z0-9]+)"

# ---- fixed values: query stop words ----
QUERY_STOPWORDS = (
    "a", "an", "and", "are", "as", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or",
    "the", "to", "what", "when", "where", "which", "why", "with",
)

# ---- fixed values: BM25 and fusion constants ----
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
SECTION_BOOST = 2.0
RRF_K = 60
RRF_MIN_WEIGHT = 0.001
SIGNAL_SCALE = 5.0
SIGNAL_MIN = 0.05
FACT_BOOST = 1.3

# ---- fixed values: reranking ----
SECTION_WEIGHTS = {
    "method": 1.2,
    "results": 1.1,
    "prose": 1.0,
    "citation_context": 0.9,
    "references": 0.3,
}
LEVEL_TARGETS = {"beginner": 0.3, "intermediate": 0.5, "advanced": 0.8}
FACT_QUERY = (
    r"\b(bleu|accuracy|score|perplexity|f1|precision|recall|rouge)\b",
    r"\b(多少|几个|数值|得分|结果是多少|准确率|正确率)\b",
    r"\b\d+\.?\d*\s*(bleu|points|percent|%)\b",
)
MAX_PER_DOC = 3
MMR_LAMBDA = 0.7
MMR_SAME_DOC = 0.3
MMR_SAME_SECTION = 0.1

# ---- fixed values: question classes, first match wins ----
INTENT = (
    ("formula", r"\b(formula|equation|latex)\b|公式|方程|推导|符号|变量"),
    ("figure", r"\b(figure|fig\.?|caption|image|diagram|plot|chart)\b|图|图片|图表|图像|可视化"),
    ("structure", r"\b(outline|agenda|structure|overview|flow|pipeline)\b|大纲|结构|脉络|流程|框架|整体|组织"),
    (
        "method",
        r"\b(method|approach|algorithm|architecture|model|procedure|work)\b"
        r"|方法|算法|架构|模型|如何工作|怎么工作",
    ),
    ("detail", r"\b(which|how many|where|when|list)\b|哪个|哪些|多少|几|列出|具体|分别|参数|数值"),
)
INTENT_DEFAULT = "concept"
DEPTH_EXPANDED = (
    r"\b(detail|detailed|expand|deep|in depth|comprehensive|example|examples|beginner|intuitive)\b"
    r"|详细|展开|深入|完整|多讲|举例|例子|通俗|从基础|不理解|仔细|全面"
)
POLICY = (
    (
        "extension",
        r"\b(extend|extension|broader|compare|comparison|versus|vs\.?|outside|beyond|related work|background)\b"
        r"|拓展|扩展|延伸|对比|比较|区别|联系|相关知识|背景知识|文档外|课外",
    ),
    (
        "learning_explanation",
        r"\b(example|examples|analogy|intuition|intuitive|beginner|explain like|why|how to understand)\b"
        r"|例子|举例|类比|直觉|通俗|初学|入门|不理解|看不懂|怎么理解|为什么",
    ),
)
POLICY_DEFAULT = "document_grounded"

# ---- fixed values: section and block patterns ----
SECTION_REFERENCES = ("references", "bibliography")
SECTION_METHOD = "method|approach|model|architecture"
SECTION_RESULTS = "result|experiment|evaluation"
CROSS_REF = (
    r"(?i)((?:see\s+)?(?:Fig(?:ure)?\.?\s*\d+)"
    r"|(?:see\s+)?(?:Eq(?:uation)?\.?\s*\(?\d+\)?)"
    r"|(?:see\s+)?(?:Table\.?\s*\d+)"
    r"|(?:see\s+)?(?:Section\.?\s*[\d.]+))"
)
FORMULA_MARKUP = (
    r"(?s)\$\$.+?\$\$|\$.+?\$|\\begin\{equation\}.*?\\end\{equation\}|\\begin\{align\}.*?\\end\{align\}"
)
FORMULA_LINE = (
    r"(?i)(?:softmax|LayerNorm|sqrt|frac|sum|prod|argmax|argmin|\\[a-zA-Z]+|[A-Za-z]\s*[\^_=]\s*[A-Za-z0-9({])"
)
HEADING = r"^#{1,6}\s+\S+|^\d+(?:\.\d+)*\.?\s+[A-Z][\w\s:/,-]{1,80}$"
LIST_ITEM = r"^(?:[-*+]\s+|\d+[.)]\s+)"
CAPTION = r"(?i)^(?:Fig(?:ure)?\.?|Table)\s*\d+[:.]\s+"
EQUATION_ENV = r"\\begin\{(?:equation|align)\}"
EQUATION_LINE = r"^[A-Za-z][\w\s^_{}\\()+*/.,-]*=\s*.+$"
TEACHING_LABELS = ("definition", "theorem", "example", "proof", "note", "key idea")
VISUAL_TYPES = ("formula", "table", "chart", "diagram", "mixed")
VISION_LABELS = ("Formula summary", "Table summary", "Chart summary", "QA hint")
CHUNK_POLICY = {"research_paper": (800, 100), "slides_pdf": (500, 50)}
FACT_MAX_TOKENS = 200

# ---- fixed values: mathematical notation ----
LATEX_NAMES = (
    ("\\alpha", "alpha"),
    ("\\beta", "beta"),
    ("\\gamma", "gamma"),
    ("\\lambda", "lambda"),
    ("\\mu", "mu"),
    ("\\sigma", "sigma"),
    ("\\theta", "theta"),
    ("\\cdot", " dot "),
    ("\\times", " times "),
    ("\\sqrt", " sqrt "),
    ("\\sum", " sum "),
    ("\\int", " integral "),
    ("\\infty", " infinity "),
    ("\\leq", " <= "),
    ("\\geq", " >= "),
    ("\\neq", " != "),
    ("\\approx", " approx "),
)
SYMBOL_NAMES = {
    "𝛼": "alpha", "α": "alpha",
    "𝛽": "beta", "β": "beta",
    "𝛾": "gamma", "γ": "gamma",
    "𝜆": "lambda", "λ": "lambda",
    "𝜇": "mu", "μ": "mu",
    "𝜎": "sigma", "σ": "sigma",
    "𝜃": "theta", "θ": "theta",
    "∙": " dot ", "·": " dot ", "⋅": " dot ",
    "×": " times ",
    "⊙": " elementwise product ",
    "√": " sqrt ",
    "∑": " sum ", "Σ": " sum ",
    "∫": " integral ",
    "∞": " infinity ",
    "≤": " <= ",
    "≥": " >= ",
    "≠": " != ",
    "≈": " approx ",
    "′": " prime ", "’": " prime ",
}
MATH_WORDS = (
    "alpha", "beta", "gamma", "lambda", "mu", "sigma", "theta", "dot", "times", "sqrt", "sum", "integral",
    "softmax", "argmax", "log", "loss", "matrix",
)
MATH_LIKE = r"[\$\\=+\-*/^_{}()\[\]<>≤≥≠≈∙·⋅×⊙√∑Σ∫∞𝒂-𝒛𝑨-𝒁𝑎-𝑧𝛼-𝜔α-ω]"
MATH_OPERATORS = r"[=+*/^_≤≥≠≈∙·⋅×⊙√∑Σ∫]"
MATH_TERMS = (r"\bq\s+dot\s+k\b", r"\bk\s+transpose\b", r"\bsoftmax\b", r"\balpha\b")

# ---- fixed values: parse quality, recognition and enhancement ----
EXPECTED_CHARS = {"research_paper": 800, "slides_pdf": 120}
EXPECTED_CHARS_DEFAULT = 400
SLIDES_MAX_CHARS = 300
LOW_TEXT_CHARS = 20
NEAR_EMPTY_CHARS = 4
VISUAL_DENSITY = 0.18
BARE_TITLES = ("agenda", "summary", "outline", "overview")
VISION_REASONS = ("diagram_signal", "chart_signal", "formula_signal", "complex_table_signal")
QUALITY_BONUS = {"good": 0.25, "weak": 0.02, "failed": -0.4}
SOURCE_BONUS = {"vision": 0.12, "ocr": 0.04, "parser": 0.08}

# ---- fixed values: learning memory ----
CONCEPT_EVENTS = ("chat_question", "explain_text", "translate_text", "section_read")
CONCEPT_PHRASES = (
    "self-attention",
    "positional encoding",
    "graph neural network",
    "attention formula",
    "query key value",
    "multi-head attention",
    "transformer architecture",
)
CONCEPT_STOPWORDS = (
    "what", "is", "are", "the", "a", "an", "of", "and", "or", "to", "in", "on", "how", "why", "does", "do",
    "this", "that", "with", "for", "about", "explain", "please", "use", "used", "here", "there",
)
NEEDS_REVIEW = "不理解|不会|困惑|看不懂|confus|struggl|formula|公式|推导"
SIGNALS_KEPT = 20
ACTIONS_KEPT = 8
GLOSSARY_KEPT = 20
GLOSSARY_SEPARATOR = "|||"
TOKEN_BUDGET = 4600

# ---- fixed values: glossary ----
TERM_TRANSLATIONS = {
    "RAG": "检索增强生成",
    "LLM": "大语言模型",
    "self-attention": "自注意力",
    "reranker": "重排器",
    "Transformer": "Transformer 模型",
    "embedding": "嵌入表示",
}

# ---- fixed values: bibliography ----
REFERENCE_HEADER = r"\n\s*(?:References|Bibliography|REFERENCES|BIBLIOGRAPHY)\s*\n"
REFERENCE_ENTRY = r"(?s)\[(\d+)\]\s*(.+?)(?=\n\[|\z)"
CITATION = r"\[(\d+(?:[,\-]\s*\d+)*)\]"
YEAR = r"\b((?:19|20)\d{2})\b"
