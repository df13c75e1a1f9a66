"""Word lists, lookup tables, patterns and texts.

Every name in this file is a fixed value. The results of the operators depend on
these exact values and on their order, so they are written out as plain text.
"""

from __future__ import annotations

# --- markets, platforms, languages -----------------------------------------------------

# code, label, region, default language
MARKETS = [
    ("US", "United States", "AMER", "en"),
    ("CA", "Canada", "AMER", "en"),
    ("MX", "Mexico", "LATAM", "es"),
    ("BR", "Brazil", "LATAM", "pt-BR"),
    ("AR", "Argentina", "LATAM", "es"),
    ("GB", "United Kingdom", "EU", "en"),
    ("ES", "Spain", "EU", "es"),
    ("DE", "Germany", "EU", "de"),
    ("FR", "France", "EU", "fr"),
    ("IT", "Italy", "EU", "it"),
    ("PT", "Portugal", "EU", "pt-PT"),
    ("DK", "Denmark", "EU", "da"),
    ("FI", "Finland", "EU", "fi"),
    ("SE", "Sweden", "EU", "sv"),
    ("NO", "Norway", "EU", "no"),
    ("AE", "United Arab Emirates", "MENA", "ar"),
    ("SA", "Saudi Arabia", "MENA", "ar"),
]

# alias, canonical name; the first alias contained in the text wins
PLATFORM_ALIASES = [
    ("tiktok", "tiktok"),
    ("douyin", "douyin"),
    ("youtube", "youtube"),
    ("youtube shorts", "youtube"),
    ("instagram", "instagram"),
    ("instagram reels", "instagram"),
    ("x", "x"),
    ("twitter", "x"),
    ("reddit", "reddit"),
    ("discord", "discord"),
]

DISTRIBUTION_MODES = ["organic", "branded_content", "paid_ads"]

PRODUCT_CATEGORIES = [
    "general",
    "beauty",
    "electronics",
    "fashion",
    "food_beverage",
    "health_supplement",
]

LANGUAGE_ALIASES = {
    "中文 (chinese)": "zh",
    "中文": "zh",
    "english": "en",
    "español (spanish)": "es",
    "español": "es",
    "espanol (spanish)": "es",
    "espanol": "es",
    "spanish": "es",
    "português (portuguese)": "pt-BR",
    "português": "pt-BR",
    "portugues (portuguese)": "pt-BR",
    "portugues": "pt-BR",
    "portuguese": "pt-BR",
    "français (french)": "fr",
    "français": "fr",
    "francais (french)": "fr",
    "francais": "fr",
    "french": "fr",
    "deutsch (german)": "de",
    "deutsch": "de",
    "german": "de",
    "italiano": "it",
    "italian": "it",
    "dansk": "da",
    "danish": "da",
    "suomi": "fi",
    "finnish": "fi",
    "svenska": "sv",
    "swedish": "sv",
    "norsk": "no",
    "norwegian": "no",
    "العربية (arabic)": "ar",
    "العربية": "ar",
    "arabic": "ar",
    "日本語 (japanese)": "ja",
    "日本語": "ja",
    "japanese": "ja",
}

DEFAULT_STYLE = "默认客观风格"

# --- knowledge corpus -------------------------------------------------------------------

RELEVANT_CATEGORIES = [
    "market_law",
    "platform_policy",
    "brand_policy",
    "campaign_brief",
    "brand_history",
]

# category, search group
CATEGORY_GROUPS = [
    ("market_law", "law"),
    ("platform_policy", "platform"),
    ("brand_policy", "brand"),
    ("campaign_brief", "brand"),
    ("brand_history", "brand"),
]

# category, order, quota in the balanced result
CATEGORY_QUOTAS = [
    ("market_law", 1, 3),
    ("platform_policy", 2, 3),
    ("brand_policy", 3, 1),
    ("campaign_brief", 4, 1),
    ("brand_history", 5, 1),
]

REQUIRED_CATEGORIES = ["market_law", "platform_policy"]

PRIORITY_WEIGHTS = {"P0": 12, "P1": 8, "P2": 4, "P3": 1}

EMBEDDING_DIM = 384
CHUNK_CHARS = 1200
EXCERPT_CHARS = 1400

NOISE_LINES = ["draft", "confidential", "table of contents", "toc"]
PAGE_LINE_PATTERN = r"page \d+(\s+of\s+\d+)?"

PLATFORM_DISPLAY = {
    "all": "All Platforms",
    "discord": "Discord",
    "douyin": "Douyin / WeChat Channels",
    "instagram": "Instagram Reels",
    "ragflow": "RAGFlow",
    "reddit": "Reddit",
    "tiktok": "TikTok",
    "x": "X",
    "youtube": "YouTube Shorts",
}

COUNTRY_CODE_ALIASES = {"UK": "GB"}

DOCUMENT_TYPES = {
    "internal_brand": "internal_brand_reference",
    "market_law": "market_law",
    "platform_policy": "platform_policy",
    "technical_reference": "technical_reference",
}

PARSER_VERSION_RAW = "rag-normalizer-v1"
PARSER_VERSION_UPLOAD = "library-direct-upload-v1"

RAW_SUFFIXES = [".html", ".pdf"]
DIRECT_SUFFIXES = [".md", ".markdown", ".txt"]

# contents entry and first kept heading of the one source whose contents list is cut
CONTENTS_CUT = {"law_uk_asa_pdf": ("# Table of contents", "# Who are you?")}

# --- markdown and page clean-up ---------------------------------------------------------

PAGE_NUMBER_PATTERN = r"(?i)^(page\s+)?\d+\s*$"
LIST_MARK_PATTERN = r"^(\d+[\.\)]|[A-Za-z][\.\)]|[-*•])\s+"
EMPTY_TABLE_ROW_PATTERN = r"^\|\s*(\|\s*)+\|?$"
CONTENTS_LINK_PATTERN = r"(?i)^\[table of contents\]\(.*\)$"
FOOTER_SLOGAN_PATTERN = r"(?i)^(?:\d+\s+)?legal, decent, honest and truthful(?:\s+\d+)?$"
WATERMARKS = ["draft", "confidential"]
DROPPED_PREFIXES = ["[Skip", "Cookie"]

DROPPED_TAGS = [
    "script",
    "style",
    "noscript",
    "svg",
    "canvas",
    "form",
    "button",
    "input",
    "select",
    "textarea",
    "iframe",
    "picture",
    "img",
    "video",
    "audio",
]

BOILERPLATE_TAGS = ["nav", "header", "footer", "aside"]

NOISE_ATTR_KEYWORDS = [
    "alert",
    "banner",
    "breadcrumb",
    "cookie",
    "footer",
    "header",
    "hero-nav",
    "lang-switcher",
    "language",
    "masthead",
    "menu",
    "nav",
    "newsletter",
    "pagination",
    "promo",
    "related",
    "search",
    "share",
    "sidebar",
    "social",
    "subscribe",
    "toc",
    "toolbar",
]

CONTENT_ATTR_KEYWORDS = ["content", "article", "policy", "markdown"]

NOISE_HEADINGS = [
    "back to top",
    "contact us",
    "contact the competition bureau",
    "ctx footer menu 1",
    "ctx footer menu 2",
    "ctx footer menu 3",
    "footer",
    "further reading",
    "language selection",
    "menu",
    "ready to get started?",
    "search form",
    "site menu",
    "want to receive updates?",
    "wxt search form",
    "you are here",
]

BLOCK_SIGNALS = [
    "captcha",
    "access denied",
    "just a moment",
    "enable javascript",
    "request blocked",
]

# content type, file extension, for the types a crawl meets besides html, text and pdf
CONTENT_TYPE_EXTENSIONS = {
    "application/json": ".json",
    "application/xml": ".xml",
    "application/zip": ".zip",
    "application/msword": ".doc",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/octet-stream": ".bin",
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/svg+xml": ".svg",
}

# --- review rules -----------------------------------------------------------------------

DISCLOSURE_KEYWORDS = [
    "#ad",
    "#advertisement",
    "#sponsored",
    "#paidpartnership",
    "paid partnership",
    "sponsored by",
    "in partnership with",
    "ad:",
    "advertisement",
    "publicidad",
    "contenido de marca",
    "patrocinado",
    "parceria paga",
    "publi",
    "werbung",
    "anzeige",
    "sponsorisé",
    "محتوى برعاية",
    "إعلان",
]

DISCLOSURE_MODES = ["branded_content", "paid_ads"]
SENSITIVE_PRODUCTS = ["health_supplement", "beauty", "food_beverage"]

# pattern, claim kind
ABSOLUTE_PATTERNS = [
    (r"\b(best|number one|#1|no\.?1|perfect|always|never|guaranteed|guarantee)\b", "absolute_claim"),
    (r"\b(100%|risk[- ]free|completely safe|zero risk|safest)\b", "absolute_claim"),
    (r"\b(miracle|instantly|immediately|overnight)\b", "unsupported_claim"),
    (r"\b(mejor|garantizado|perfecto|siempre|nunca)\b", "absolute_claim"),
    (r"\b(100%|sin riesgo|cura|milagro|instantáneamente)\b", "unsupported_claim"),
    (r"\b(melhor|garantido|perfeito|sempre|nunca)\b", "absolute_claim"),
    (r"\b(cura|milagre|instantaneamente)\b", "unsupported_claim"),
    (r"\b(meilleur|garanti|parfait|toujours|jamais)\b", "absolute_claim"),
    (r"\b(heil|wunder|sofort|garantiert)\b", "unsupported_claim"),
]

SENSITIVE_PATTERNS = [
    r"\b(cure|treat|heal|prevent|diagnose|weight loss|fat burn|anti[- ]aging|clinically proven)\b",
    r"\b(curar|tratar|prevenir|pérdida de peso|anti edad|clínicamente probado)\b",
    r"\b(curar|tratar|prevenir|perda de peso|anti idade|clinicamente comprovado)\b",
    r"\b(guérir|traiter|prévenir|perte de poids|anti[- ]âge)\b",
    r"\b(heilen|behandeln|vorbeugen|gewichtsverlust|klinisch bewiesen)\b",
    r"\b(يعالج|يشفي|يمنع|إنقاص الوزن|مثبت سريريًا)\b",
]

DISCLOSURE_FIXES = {
    "tiktok": "Add a clear paid partnership disclosure in the opening hook and caption, such as `Paid partnership with <brand>` or `#ad`.",
    "instagram": "Use a clear `Paid partnership` disclosure in the reel and caption before product claims.",
    "youtube": "Include an on-screen sponsorship disclosure and a clear paid promotion label in the script.",
    "x": "Add a clear ad or sponsorship disclosure before the promotional claim appears.",
    "reddit": "Add an explicit sponsorship disclosure and confirm the community allows promotional posts before publishing.",
    "discord": "Add a clear sponsor disclosure and avoid dropping undisclosed ads into community channels.",
}
DISCLOSURE_FIX_DEFAULT = "Add a clear sponsorship disclosure before the promotional claim appears."
DISCLOSURE_REASON = "The draft looks promotional but does not include a visible sponsorship or branded-content disclosure."
DISCLOSURE_NO_LINE = "No excerpt available"
ABSOLUTE_REASON = "This line uses absolute or certainty-heavy language that often needs stronger substantiation or softer wording in ad copy."
ABSOLUTE_FIX = "Replace the absolute wording with measured, supportable language and keep the claim tied to verifiable product facts."
SENSITIVE_REASON = "This looks like a health, efficacy, or treatment claim for a sensitive product category and usually requires strong evidence plus careful wording."
SENSITIVE_FIX = "Remove the medical or therapeutic promise unless you have market-specific substantiation. Reframe it as a softer user benefit or product description."

# citation preferences per rule family: categories, terms
CITATION_PREFERENCES = {
    "disclosure": (
        ["platform_policy", "market_law"],
        ["disclosure", "advertising", "branded content", "paid partnership"],
    ),
    "absolute": (["market_law"], ["misleading", "deceptive", "advertising", "commercial practice"]),
    "sensitive": (["market_law"], ["misleading", "health", "safety", "claims"]),
}

# --- reports ----------------------------------------------------------------------------

REPORT_STATUSES = ["approved", "needs_revision", "insufficient_evidence"]
RISK_ORDER = [("low", 1), ("medium", 2), ("high", 3)]

ISSUE_DEFAULTS = {
    "excerpt": "No excerpt available",
    "risk_level": "medium",
    "issue_type": "local_law",
    "reason": "No reason provided.",
    "suggested_fix": "Revise the wording to make the claim safer and more specific.",
}
CITATION_DEFAULTS = {
    "source_title": "Untitled source",
    "country_code": "GLOBAL",
    "page_num": "",
    "heading_path": "",
    "block_id": "",
    "source_url": "",
}
REPORT_DEFAULTS = {
    "headline": "Compliance review",
    "overall_commentary": "The script was checked against the scoped compliance evidence and rule engine.",
    "closing_note": "Review the flagged excerpts and apply the suggested revisions before creator delivery.",
}
FALLBACK_HEADLINE = "Compliance review needs more scoped evidence"
FALLBACK_NOTE = "The system kept deterministic rule hits, but you should treat this review as incomplete until more local evidence is indexed."
FALLBACK_ISSUE_TYPE = "missing_local_evidence"
FALLBACK_FIX = "Import local law, platform policy, or brand brief files for the selected market and rerun review."
REASON_NO_SCRIPT = "The script generator did not produce any content to review."
REASON_NO_EVIDENCE = "No local or scoped knowledge base evidence matched the selected country, platform, and distribution mode."
REASON_NO_JSON = "The compliance reviewer could not return structured JSON. The deterministic rule engine findings are preserved below."
NO_EVIDENCE_DIGEST = "No scoped evidence was found."

# --- script markdown --------------------------------------------------------------------

SCRIPT_START_PATTERNS = [
    r"(?m)^###\s+",
    r"(?m)^\*\*(?:Title|标题|Título|Titre|Titel|العنوان|タイトル)\*\*",
    r"(?m)^\|\s*\[?\d{2}:\d{2}-\d{2}:\d{2}\]?\s*\|",
    r"(?m)^\[\d{2}:\d{2}-\d{2}:\d{2}\]\s*\|",
]
LEADING_FENCE_PATTERN = r"(?i)^\s*```(?:markdown|md)?\s*"
TRAILING_FENCE_PATTERN = r"(?i)\s*```\s*$"
TABLE_RULE_PATTERN = r"^\s*\|?(?:\s*:?-{3,}:?\s*\|){3,}\s*$"
TIME_HEADER_PATTERN = r"(?i)(time|时间|时码|time code)"
VISUAL_HEADER_PATTERN = r"(?i)(visual|镜头|画面|动作)"
AUDIO_HEADER_PATTERN = r"(?i)(audio|声音|对白|旁白|bgm)"
SCENE_CELL_PATTERN = r"(?i)^\s*(scene|场景|镜头|escena|scène|szene|مشهد|シーン)\b"
INT_EXT_CELL_PATTERN = r"(?i)^\s*(int|ext|int/ext|interior|exterior|室内|室外|内景|外景|int\.|ext\.)\b"
TIMECODE_PATTERN = r"\[\d{2}:\d{2}-\d{2}:\d{2}\]"
FENCED_JSON_PATTERN = r"(?s)```json\s*(\{.*\})\s*```"
BARE_JSON_PATTERN = r"(?s)(\{.*\})"

# --- trends -----------------------------------------------------------------------------

VIRAL_PLATFORMS = ["tiktok", "instagram", "x"]

# platform, host parts
PLATFORM_HOSTS = [
    ("tiktok", ["tiktok.com"]),
    ("instagram", ["instagram.com"]),
    ("x", ["x.com", "twitter.com"]),
]
PLATFORM_LABELS = {"tiktok": "TikTok", "instagram": "Instagram Reels", "x": "X"}
VIRAL_QUERY_HINTS = {
    "tiktok": (
        "{country} {focus} TikTok viral video public creator post last {days} days",
        "{country} {focus} TikTok short video trending example public post",
    ),
    "instagram": (
        "{country} {focus} Instagram Reels viral creator video last {days} days",
        "{country} {focus} Instagram Reels high views creator example",
    ),
    "x": (
        "{country} {focus} X Twitter viral video creator post last {days} days",
        "{country} {focus} X Twitter trending clip high engagement",
    ),
}
VIRAL_QUERY_DEFAULT = ("{country} {focus} viral social video public post last {days} days",)
PRODUCT_HINTS = {
    "general": "creator storytelling",
    "beauty": "beauty skincare makeup creator review",
    "electronics": "tech gadget electronics creator review",
    "fashion": "fashion outfit styling creator review",
    "food_beverage": "food beverage snack drink creator review",
    "health_supplement": "health supplement wellness creator review",
}
DISTRIBUTION_HINTS = {
    "organic": "organic creator trend audience engagement",
    "branded_content": "brand partnership creator sponsored style",
    "paid_ads": "performance creative paid social winning ad",
}
FOCUS_DEFAULT = "creator product storytelling"
VIEW_LABEL_LIVE = "实时命中"
VIRAL_TITLE_DEFAULT = "Viral video"

UNIT_VIEWS_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*([mk])\s*(?:views?|plays?)"
MILLION_VIEWS_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*million\s*(?:views?|plays?)"
COMMA_VIEWS_PATTERN = r"(?i)([1-9]\d{0,2}(?:,\d{3})+)\s*(?:views?|plays?)"
RELATIVE_AGE_PATTERN = r"(?i)(\d+)\s*([dhw])\s*ago"
ISO_DATE_PATTERN = r"\b(20\d{2})-(\d{1,2})-(\d{1,2})\b"
SHORT_DATE_PATTERN = r"[·•]\s*(\d{1,2})-(\d{1,2})\b"
LONG_DATE_PATTERNS = [
    r"\b([A-Z][a-z]+ \d{1,2}, \d{4})\b",
    r"\b([A-Z][a-z]+ \d{1,2},\s*20\d{2})\b",
]

TREND_PLATFORM_HINTS = {
    "tiktok": "short-form video trends, creator hooks, UGC style, viral editing patterns",
    "instagram": "reels trends, influencer hooks, product storytelling, visual-first angles",
    "youtube": "shorts trends, search-friendly hooks, retention patterns, creator talking points",
    "x": "conversation spikes, punchy talking points, meme angles, reply-driven hooks",
    "reddit": "community pain points, authentic proof points, discussion-led angles, objections",
    "discord": "community activation, launch messaging, event hooks, insider language",
    "douyin": "short-form hooks, high-retention editing, creator product demo formats",
}
TREND_PLATFORM_HINT_DEFAULT = "platform trends, hooks, creative angles"
TREND_MODE_HINTS = {
    "organic": "focus on audience interest, discoverability, creator-native storytelling",
    "branded_content": "focus on sponsor-safe hooks, creator-brand fit, disclosure-friendly formats",
    "paid_ads": "focus on ad-safe claims, conversion hooks, policy-sensitive wording",
}
TREND_MODE_HINT_DEFAULT = "campaign-safe messaging and creator-native angles"
TREND_QUERY_TEMPLATE = (
    "{topic} {country} {platform} {product} social media trend "
    "viral hooks creator insights audience pain points {platform_hint} {mode_hint} "
    "content examples language {language}"
)
LIVE_TREND_MARK = "[Live Trend Intelligence]"
FALLBACK_TREND_MARK = "[Trend Intelligence Fallback]"
FALLBACK_ASSUMPTION = (
    "- Working Assumption: prioritize a fast hook in the first 3 seconds, explicit product payoff, "
    "audience pain point framing, and creator-native wording."
)
NO_SIGNALS_LINE = "- Recent Signals: No reliable live search results were returned."
EMPTY_TOPIC_BRIEF = "未填写主题时，这里只展示行业情报与热点视频缓存。"

# what a module answers before anything is laid over it
EMPTY_PAYLOADS = {
    "videos": '{"error":"","items":[]}',
    "industry_categories": '{"categories":[],"error":""}',
    "topic_brief": '{"error":"","topic_brief":{"trend_data":"","trend_query":"","trend_sources":[]}}',
}
EMPTY_BRIEF = '{"trend_data":"","trend_query":"","trend_sources":[]}'

# key, label, query template
INDUSTRY_CATEGORIES = [
    (
        "technology",
        "科技行业",
        "{country} technology AI creator economy consumer tech platform update "
        "{platform} short video trend {topic} last 7 days",
    ),
    (
        "video",
        "视频行业",
        "{country} short-form video industry creator monetization platform update "
        "{platform} video commerce retention trend {topic} last 7 days",
    ),
    (
        "marketing",
        "营销行业",
        "{country} influencer marketing creator partnership paid social brand campaign "
        "{platform} social commerce trend {topic} last 7 days",
    ),
]
INDUSTRY_TOPIC_DEFAULT = "creator economy"

# --- talents ----------------------------------------------------------------------------

# stage, title, words in the progress text; the first stage with a word wins
TALENT_STAGES = [
    ("pending", "待沟通", ["待沟通"]),
    ("contacting", "沟通中", ["跟进", "对接", "沟通"]),
    ("signed", "已签约", ["推进", "签约", "已签"]),
    ("producing", "内容制作", ["制作", "拍摄", "创作"]),
    ("done", "已完成", ["已合作", "完成", "交付"]),
]
TONE_LOW_WORDS = ["已合作", "完成", "交付"]
TONE_MEDIUM_WORDS = ["跟进", "推进", "对接", "沟通", "签约", "制作", "拍摄", "创作"]
TONE_LOW, TONE_MEDIUM, TONE_MUTED = "risk-low", "risk-medium", "topbar-chip-muted"
PLATFORM_UNSET = "未设置"
PROGRESS_UNSET = "待沟通"
BACKFILL_NOTES = "从原 users 表同步，待补充达人备注。"
BACKFILL_NAME_PREFIX = "达人 "
STYLE_PROMPT_TEMPLATE = "你是达人{name}，请基于达人定位输出自然、有辨识度的短视频脚本。"
# stage, field that may be blank, priority and text when blank, priority and text when filled
TALENT_TODOS = [
    ("pending", "email", "high", "补充达人「{name}」的联系邮箱", "medium", "发送合作意向邮件给「{name}」"),
    ("contacting", "recent_video_link", "medium", "收集「{name}」的近期代表作链接", "medium", "与「{name}」确认合作条款并推进签约"),
    ("signed", "notes", "medium", "为「{name}」补充创作风格备注", "high", "启动「{name}」的脚本生成任务"),
    ("producing", None, "medium", "跟进「{name}」的拍摄进度并确认交付日期", "medium", "跟进「{name}」的拍摄进度并确认交付日期"),
    ("done", None, "low", "「{name}」合作已完成，可考虑二次合作", "low", "「{name}」合作已完成，可考虑二次合作"),
]

# --- workflow progress ------------------------------------------------------------------

GENERATE_STEPS = ["profiler", "trend_hunter", "script_writer", "compliance", "rewriter"]
REVIEW_STEPS = ["compliance_scan", "compliance_fix"]
LLM_STEPS = ["script_writer", "rewriter", "compliance_fix"]
LLM_BUSY_WORDS = ["rate", "429", "timeout", "api", "quota", "connection"]
COMPLIANCE_STEPS = ["compliance", "compliance_scan"]
# error type, message; {assistant} is the display name of the assistant
STEP_ERRORS = {
    "search_timeout": "网络数据源暂时开小差了，{assistant} 本次没有捕获到热点。",
    "llm_busy": "当前 AI 服务繁忙，{assistant} 暂时排不上队了。",
    "compliance_blocked": "为了保护你的账号安全，系统拦截了本次内容，请先调整需求后再试。",
    "workflow_error": "这一步暂时没有顺利完成，我们可以稍后再试一次。",
}
SYSTEM_ERROR_MESSAGE = "流程中断了，请稍后重新开始。"
HEARTBEAT_SECONDS = 15
TIMEOUT_SECONDS = 120

# --- library ----------------------------------------------------------------------------

LIBRARY_DEFAULTS = {
    "category": "platform_policy",
    "market": "GLOBAL",
    "region": "GLOBAL",
    "platform": "all",
    "language": "en",
    "priority": "P2",
}
UPLOAD_EMPTY = "上传文件为空。"
UPLOAD_SUFFIX = "仅支持上传 pdf、html、md、markdown、txt 文件。"
UPLOAD_BLANK = "文本资料内容为空。"
NO_CATALOG_ENTRY = "Missing source catalog entry for "
CRAWL_STATUSES = ["downloaded", "manual_required", "failed", "blocked"]
