"""Word lists, markers, limits and labels the audit is defined by.

Everything in this module is data.  Matching is always plain substring, prefix
or suffix matching on lower-cased text unless a comment says otherwise.
"""

# ---------------------------------------------------------------------------
# Page extraction
# ---------------------------------------------------------------------------
SCRIPT_CATEGORIES = (
    ("analytics", ("google-analytics", "gtag/js", "analytics")),
    ("advertising", ("doubleclick", "ads", "adservice")),
    ("social", ("facebook", "twitter", "linkedin")),
)
SCRIPT_CATEGORY_OTHER = "other"

INLINE_TRACKER_MARKERS = ("google-analytics", "gtag(", "fbq(", "datalayer")
INLINE_TRACKER_SRC = "inline:tracking"
INLINE_TRACKER_CATEGORY = "analytics"

POLICY_LINK_PHRASES = ("privacy", "privacidade", "cookies", "terms", "termos")

LEGAL_LINK_PHRASES = (
    "privacidade", "privacy", "cookies", "termos", "terms",
    "condições gerais", "condições de utilização", "terms and conditions",
    "rgpd", "gdpr", "proteção de dados", "data protection",
    "encarregado de proteção de dados", "data protection officer",
    "contactos", "contact us",
)
MAX_LEGAL_LINKS = 5
MAX_POLICY_PAGES = 5

PRIVACY_NOTICE_PHRASES = (
    "dados pessoais", "política de privacidade", "privacidade",
    "rgpd", "gdpr", "finalidade", "tratamento dos seus dados",
    "tratamento de dados", "privacy policy", "personal data",
    "how we use your data", "how your data",
)
NOTICE_LEVELS = 3

BANNER_PHRASES = (
    "aceitar cookies", "accept cookies", "cookie consent",
    "este site utiliza cookies", "we use cookies",
)
BANNER_TAGS = ("div", "section", "aside")
BANNER_MARKERS = (
    "onetrust", "didomi", "quantcast", "cookiebot", "cookieadmin",
    "cmp-banner", "cookie-banner", "cookieconsent", "qc-cmp2",
)

# Elements that never have content, as HTML defines them (current and obsolete).
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid",
    "spacer",
)

# ---------------------------------------------------------------------------
# cookies
# ---------------------------------------------------------------------------
TRACKING_COOKIE_PREFIXES = (
    "_ga", "_gid", "_gat", "amp_token", "_gac_",
    "__utma", "__utmb", "__utmc", "__utmt", "__utmz",
    "_fbp", "_fbc", "fr", "tr",
    "_pin_unauth",
    "uid", "ouid", "tuuid",
    "_tt_enable_cookie", "_ttp",
    "lidc", "bcookie", "bscookie",
    "muc_optin", "guest_id", "personalization_id",
    "yandexuid", "ymex",
)
TRACKING_COOKIE_DOMAINS = (
    ".google.com", ".doubleclick.net", ".facebook.com", ".twitter.com",
    ".linkedin.com", ".tiktok.com", ".pinterest.com", ".amazon-adsystem.com",
    ".bing.com", "ads.yahoo.com",
)
COOKIE_TRACKING = "Tracking/Analytics"
COOKIE_OTHER = "Desconhecido/Necessário/Funcional"

# ---------------------------------------------------------------------------
# Policy dictionaries, (element, language) -> phrases
# ---------------------------------------------------------------------------
POLICY_ELEMENTS = (
    "identity_controller", "dpo_contact", "legal_basis", "right_access",
    "right_rectification", "right_erasure", "right_portability",
    "international_transfers", "retention_period", "right_complaint",
)
POLICY_PHRASES = {
    "pt": {
        "identity_controller": (
            "responsável pelo tratamento", "responsável pelo processamento",
            "responsável pelo tratamento dos dados", "responsável pelos seus dados",
        ),
        "dpo_contact": (
            "encarregado de proteção de dados", "data protection officer", "dpo",
            "contacto do dpo", "contacto do encarregado de proteção de dados",
        ),
        "legal_basis": (
            "base legal", "fundamento jurídico", "fundamento legal",
            "base de legitimidade", "consentimento", "interesse legítimo",
            "obrigação legal", "execução de contrato",
        ),
        "right_access": (
            "direito de acesso", "acesso aos dados", "direito de acesso aos dados",
            "acesso aos dados pessoais", "aceder aos seus dados",
            "solicitar acesso aos seus dados",
        ),
        "right_rectification": (
            "direito de retificação", "direito de rectificação",
            "retificar os dados", "corrigir os seus dados",
        ),
        "right_erasure": (
            "direito ao apagamento", "direito a ser esquecido",
            "apagar os seus dados", "eliminar os seus dados",
        ),
        "right_portability": (
            "direito à portabilidade", "portabilidade dos dados",
            "transferir os seus dados",
        ),
        "international_transfers": (
            "transferência internacional", "transferências internacionais",
            "fora da união europeia", "transferência de dados para fora",
            "fora do espaço económico europeu", "estados unidos", "eua", "e.u.a",
            "país terceiro", "países terceiros", "cláusulas contratuais-tipo",
            "cláusulas contratuais tipo", "decisão de adequação",
        ),
        "retention_period": (
            "prazo de conservação", "período de conservação",
            "tempo de conservação", "prazo de retenção", "período de retenção",
            "conservados pelo prazo", "durante quanto tempo guardamos os dados",
            "durante quanto tempo são conservados",
        ),
        "right_complaint": (
            "direito a apresentar reclamação", "cnpd", "autoridade de controlo",
            "direito de reclamação", "apresentar reclamação",
            "comissão nacional de proteção de dados",
        ),
    },
    "en": {
        "identity_controller": (
            "data controller", "controller responsible for",
            "controller of your data",
        ),
        "dpo_contact": (
            "data protection officer", "dpo", "contact the dpo",
            "dpo contact details",
        ),
        "legal_basis": (
            "legal basis", "lawful basis", "consent", "legitimate interest",
            "basis for processing", "legal obligation", "contractual necessity",
            "performance of a contract",
        ),
        "right_access": (
            "right of access", "access to your data",
            "access to your personal data",
        ),
        "right_rectification": (
            "right to rectification", "rectify your data",
            "right to correct your data", "correct inaccurate data",
        ),
        "right_erasure": (
            "right to erasure", "right to be forgotten", "erase your data",
            "delete your data",
        ),
        "right_portability": (
            "right to data portability", "data portability",
            "transfer your data to another",
        ),
        "international_transfers": (
            "international transfers", "outside the european union",
            "outside the eea", "outside the eu", "united states",
            "third country", "standard contractual clauses", "adequacy decision",
        ),
        "retention_period": (
            "retention period", "storage period", "how long we keep",
            "how long your data is kept",
        ),
        "right_complaint": (
            "right to lodge a complaint", "supervisory authority",
            "lodge a complaint", "data protection authority",
        ),
    },
}

# ---------------------------------------------------------------------------
# Rules.  (id, name, description, check, severity, article,
# recommendation), in catalogue order.
# ---------------------------------------------------------------------------
RULE_FIELDS = (
    "id", "name", "description", "check", "severity", "article", "recommendation",
)
RULES = (
    ("R01", "Missing cookie consent banner",
     "Tracking/analytics cookies were found but no cookie consent banner was detected on the page.",
     "has_tracking_cookies is True and consent_banner_detected is False",
     "high", "GDPR Art. 6 and 7",
     "Implement a consent management platform (CMP) that blocks tracking cookies until the user opts in."),
    ("R02", "Tracking cookies loaded before consent",
     "Tracking/analytics cookies are set before the user has given any consent.",
     "has_tracking_cookies is True and consent_banner_detected is False",
     "high", "GDPR Art. 6 and 7",
     "Configure the tag manager/CMP to only fire tracking scripts after explicit opt-in consent."),
    ("R03", "Analytics script without IP anonymization",
     "A Google Analytics / gtag.js script was detected without IP anonymization enabled.",
     "third_party_script matches analytics pattern and 'anonymize_ip' not in config",
     "medium", "GDPR Art. 5(1)(c) - Data minimisation",
     "Enable IP anonymization (anonymize_ip) in the analytics configuration, or use a privacy-friendly analytics tool."),
    ("R04", "Cookies without Secure/HttpOnly attributes",
     "One or more cookies are missing the Secure and/or HttpOnly attributes.",
     "any cookie where secure is False or httpOnly is False",
     "medium", "GDPR Art. 32 - Security of processing",
     "Set the Secure and HttpOnly flags on all cookies that do not need to be read by client-side JavaScript."),
    ("R05", "Privacy Policy Accessible",
     "The privacy policy is missing or not linked from the main page.",
     "privacy_policy_url is None",
     "high", "GDPR Art. 13 and 14",
     "Add a clear link to the privacy policy in the footer of all pages."),
    ("R06", "Privacy policy missing right of access",
     "The privacy policy text does not mention the data subject's right of access.",
     "policy_flags.right_access is False",
     "medium", "GDPR Art. 15",
     "Explicitly describe how users can request access to their personal data."),
    ("R07", "Privacy policy missing right to erasure",
     "The privacy policy text does not mention the right to erasure ('right to be forgotten').",
     "policy_flags.right_erasure is False",
     "medium", "GDPR Art. 17",
     "Explicitly describe how users can request deletion of their personal data."),
    ("R08", "Privacy policy missing international transfers section",
     "The privacy policy text does not mention international data transfers outside the EU/EEA.",
     "policy_flags.international_transfers is False",
     "medium", "GDPR Art. 44-49",
     "If personal data is transferred outside the EU/EEA, disclose the legal safeguards used (e.g. SCCs, adequacy decisions)."),
    ("R09", "Privacy policy missing DPO contact",
     "The privacy policy text does not identify a Data Protection Officer (DPO) or equivalent contact.",
     "policy_flags.mentions_dpo is False",
     "low", "GDPR Art. 37-39",
     "If a DPO is required, publish their contact details in the privacy policy."),
    ("R10", "Privacy policy missing data retention period",
     "The privacy policy text does not specify how long personal data is kept.",
     "policy_flags.retention_period is False",
     "medium", "GDPR Art. 13(2)(a) and 14(2)(a)",
     "State a clear retention period (or the criteria used to determine it) for each category of personal data."),
    ("R11", "Forms without purpose notice",
     "A form collects personal data (e.g. e-mail, phone, address) without a privacy notice near it explaining the purpose of processing.",
     "form has personal-data fields and has_nearby_privacy_notice is False",
     "medium", "GDPR Art. 13",
     "Add a short notice near each form explaining how the submitted data will be used, and link to the full privacy policy."),
    ("R12", "Privacy policy could not be verified",
     "The privacy policy page could not be downloaded or analyzed automatically (e.g. blocked by anti-bot protection, network timeout), so RGPD requirements about its text content could not be checked.",
     "policy_flags._policy_unreachable is True",
     "low", "N/A - tooling limitation",
     "Manually review the privacy policy page for the required GDPR elements (right of access, erasure, international transfers, DPO contact, retention period)."),
)
# Evidence messages, one per rule.
RULE_MESSAGES = {
    "R01": "Foram encontrados cookies de rastreio sem qualquer banner de consentimento visível.",
    "R02": "Foram encontrados cookies de rastreio antes da obtenção de consentimento.",
    "R03": "Foi detetado Google Analytics sem anonimização de IP.",
    "R04": "Foram encontrados cookies sem atributos Secure/HttpOnly adequados.",
    "R05": "Não foi encontrado qualquer link para política de privacidade na página analisada.",
    "R06": "Texto da política de privacidade analisado não contém referência ao direito de acesso aos dados.",
    "R07": "Texto da política de privacidade analisado não contém referência ao direito ao apagamento / direito a ser esquecido.",
    "R08": "Texto da política de privacidade analisado não contém referência a transferências internacionais de dados.",
    "R09": "Texto da política de privacidade analisado não contém referência ao Encarregado de Proteção de Dados (DPO) nem contactos associados.",
    "R10": "Texto da política de privacidade analisado não indica qualquer prazo de conservação dos dados pessoais.",
    "R11": "Foram encontrados formulários que recolhem dados pessoais sem qualquer aviso de privacidade próximo.",
    "R12": "Não foi possível descarregar/analisar automaticamente o conteúdo da política de privacidade (ex.: bloqueio por proteção anti-bot, timeout de rede). Os requisitos RGPD relacionados com o texto da política (direito de acesso, apagamento, transferências internacionais, DPO, prazo de conservação) não puderam ser verificados automaticamente e requerem revisão manual.",
}
ANALYTICS_SRC_MARKERS = ("google-analytics", "gtag/js")  # case-sensitive
PERSONAL_FIELD_PATTERNS = (
    "email", "e-mail", "mail", "telefone", "phone", "telemovel",
    "morada", "address", "nome", "name", "nif", "cc", "cartao",
    "nascimento", "birth", "password", "senha",
)
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
SEVERITY_RANK_OTHER = 99
SEVERITY_LABELS = {"high": "Alto", "medium": "Médio"}
SEVERITY_LABEL_OTHER = "Baixo"
REPORT_DATE_FORMAT = "dd/MM/yyyy HH:mm"
REPORT_KEY_FORMAT = "yyyyMMdd-HHmmss"
REPORT_DISCLAIMER = (
    "Esta ferramenta é apenas um apoio técnico e não substitui uma auditoria "
    "jurídica profissional."
)

# ---------------------------------------------------------------------------
# Store, listings, notifications, company data
# ---------------------------------------------------------------------------
SCAN_STATUSES = ("Running", "Completed", "Failed")
FINDING_STATUS_OPEN = "Open"
NO_FINDING_RULE = "Conforme"
NO_FINDING_DESCRIPTION = "Nenhuma não-conformidade detetada neste scan."
NO_FINDING_RECOMMENDATION = "Sem recomendações necessárias."
NO_FINDING_STATUS = "-"
REGISTRY_CONFIRMED = "Confirmado"
REGISTRY_NOT_CONFIRMED = "Não confirmado"
REPORT_REGISTRY_LABELS = {
    True: "Dados confirmados no Racius.com",
    False: "Dados não confirmados no Racius.com",
    None: "Registo público não consultado",
}
RULE_TO_CATEGORY = {
    "R01": "missing_cookie_consent",
    "R02": "tracking_cookies_before_consent",
    "R03": "analytics_no_ip_anonymization",
    "R04": "cookies_missing_secure_flags",
    "R05": "missing_privacy_policy",
    "R06": "policy_missing_right_of_access",
    "R07": "policy_missing_right_to_erasure",
    "R08": "policy_missing_international_transfers",
    "R09": "policy_missing_dpo_contact",
    "R10": "policy_missing_retention_period",
    "R11": "forms_without_purpose_notice",
    "R12": "privacy_policy_unreachable",
}
CATEGORY_OTHER = "generic_compliance_issue"
SEVERITY_LEVELS = {"high": 1, "medium": 2}
SEVERITY_LEVEL_OTHER = 3
FEED_CLIENT_ID = 1
FEED_DEVICE_ID = 0
FEED_AUDIT_TYPE = "website_audit"
REMOTE_ADDRESS_LENGTH = 50
COMPANY_SENTINEL = "not available"

# ---------------------------------------------------------------------------
# Independent check profile
# ---------------------------------------------------------------------------
CHECK_LINK_PHRASES = (
    "privacy", "privacidade", "politica de privacidade", "cookies", "terms",
    "termos", "protecion de datos",
)
CHECK_BANNER_PHRASES = (
    "aceitar cookies", "accept cookies", "cookie consent",
    "este site utiliza cookies", "we use cookies", "utilizamos cookies",
    "usamos cookies", "this website uses cookies", "cookie policy",
    "aceitar todos", "accept all",
)
CHECK_BANNER_MARKERS = (
    "cookie", "consent", "gdpr", "cookieadmin", "onetrust", "didomi",
    "quantcast", "consentimento",
)
CHECK_BANNER_SCRIPT_MARKERS = (
    "cookieadmin", "onetrust", "didomi", "quantcast", "cookie-consent",
    "cookieconsent", "consent", "cookiebot",
)
CHECK_ANALYTICS_SRC = ("google-analytics", "gtag/js")
CHECK_ANALYTICS_BODY = ("google-analytics", "gtag", "GA_MEASUREMENT_ID")
CHECK_FIELD_PATTERNS = (
    "email", "e-mail", "phone", "telefone", "nome", "name", "address",
    "morada", "password", "senha",
)
CHECK_NOTICE_PHRASES = (
    "dados pessoais", "privacidade", "rgpd", "gdpr", "finalidade", "privacy",
)
CHECK_SCRIPT_LIST = 10
CHECK_POLICY_PHRASES = {
    "dpo_contact": (
        "encarregado de protecao de dados", "encarregado de proteccion de dados",
        "data protection officer", "dpo", "contacto do dpo",
        "encarregado de protecion",
    ),
    "right_access": (
        "direito de acesso", "acesso aos dados", "right of access",
        "access to your data", "aceder aos seus dados",
    ),
    "right_erasure": (
        "direito ao apagamento", "direito a ser esquecido",
        "apagar os seus dados", "right to erasure", "right to be forgotten",
        "delete your data", "eliminar os seus dados",
    ),
    "international_transfers": (
        "transferencia internacional", "fora da uniao europeia",
        "outside the eu", "united states", "estados unidos", "eua",
        "pais terceiro", "standard contractual clauses",
        "clausulas contratuais", "international transfers", "outside the eea",
        "fora do espaco economico europeu",
    ),
    "retention_period": (
        "prazo de conservacao", "periodo de conservacao", "retention period",
        "how long we keep", "tempo de conservacao", "prazo de retencao",
        "periodo de retencao", "storage period", "durante quanto tempo",
    ),
}

# ---------------------------------------------------------------------------
# Our own choice (not fixed): stop words for the language vote
# ---------------------------------------------------------------------------
LANGUAGE_MIN_CHARS = 50
LANGUAGE_UNKNOWN = "unknown"
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit",
           "auf", "für", "von", "den", "dem", "auch", "sich", "wir", "sie",
           "zu", "im", "als", "oder"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "are",
           "you", "your", "we", "this", "be", "on", "or", "by", "an", "as"),
    "es": ("el", "los", "las", "y", "en", "que", "por", "con", "para", "una",
           "es", "del", "se", "su", "al", "lo", "como", "más"),
    "fr": ("le", "la", "les", "et", "des", "du", "une", "est", "dans", "pour",
           "que", "qui", "pas", "sur", "au", "avec", "il", "elle", "nous",
           "vous"),
    "pt": ("o", "os", "as", "e", "um", "uma", "do", "da", "dos", "das", "que",
           "não", "em", "para", "com", "por", "ao", "aos", "seus", "são",
           "pelo", "pela", "no", "na"),
}
