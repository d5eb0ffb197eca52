"""Fixed word lists and maps that results depend on, each in its natural order."""

# Domain vocabulary.
DOMAINS = {
    "machine_learning": ["neural network", "deep learning", "transformer", "attention", "embedding", "gradient", "backpropagation", "loss function", "training", "inference", "model", "weights", "bias", "overfitting", "regularization", "dropout", "batch normalization"],
    "web_development": ["react", "vue", "angular", "javascript", "typescript", "html", "css", "dom", "api", "rest", "graphql", "frontend", "backend", "fullstack", "responsive"],
    "devops": ["docker", "kubernetes", "ci/cd", "pipeline", "deployment", "container", "orchestration", "helm", "terraform", "aws", "gcp", "azure", "cloud", "infrastructure"],
    "data_engineering": ["etl", "pipeline", "data lake", "warehouse", "spark", "kafka", "airflow", "dbt", "sql", "nosql", "schema", "partition", "batch", "streaming"],
    "medical_devices": ["fda", "510k", "regulatory", "clinical", "validation", "verification", "ivd", "diagnostic", "qms", "iso 13485", "medical device", "patient", "healthcare", "hipaa"],
    "control_systems": ["pid", "controller", "feedback", "setpoint", "gain", "proportional", "integral", "derivative", "tuning", "stability", "transfer function", "bode", "nyquist"],
}

# Technology terms and the categories of some of them.
TECH_TERMS = ["Python", "JavaScript", "TypeScript", "React", "FastAPI", "Django", "PostgreSQL", "SQLite", "ChromaDB", "Docker", "Kubernetes", "AWS", "GCP", "Azure", "Linux", "Windows", "macOS", "Git", "GitHub", "API", "REST", "GraphQL", "OAuth", "TensorFlow", "PyTorch", "spaCy", "NLTK", "LLM", "GPT", "Claude", "Anthropic", "OpenAI", "Gemini"]
TECH_CATEGORIES = {
    "python": "languages", "javascript": "languages", "typescript": "languages",
    "react": "frameworks", "vue": "frameworks", "angular": "frameworks", "fastapi": "frameworks", "django": "frameworks", "flask": "frameworks",
    "docker": "infrastructure", "kubernetes": "infrastructure",
    "aws": "cloud", "gcp": "cloud", "azure": "cloud",
    "postgresql": "databases", "sqlite": "databases", "mongodb": "databases",
    "git": "tools", "github": "tools",
}

# Canonical first names and their short forms.
ALIASES = {
    "gabriel": ["gabe", "gabi"],
    "daniel": ["dan", "danny"],
    "michael": ["mike", "mick"],
    "robert": ["rob", "bob", "bobby"],
    "william": ["will", "bill", "billy"],
    "richard": ["rick", "dick"],
    "christopher": ["chris"],
    "matthew": ["matt"],
    "anthony": ["tony"],
    "joseph": ["joe", "joey"],
    "benjamin": ["ben"],
    "alexander": ["alex"],
    "nicholas": ["nick"],
    "jonathan": ["jon"],
    "stephen": ["steve"],
    "elizabeth": ["liz", "beth", "lizzy"],
    "jennifer": ["jen", "jenny"],
    "katherine": ["kate", "kathy", "katie"],
    "margaret": ["maggie", "meg"],
    "patricia": ["pat", "patty"],
}

# Extractors and their extensions, and folders that a walk of a drive leaves out.
EXTRACTORS = {
    "pdf": ["pdf"],
    "docx": ["docx"],
    "markdown": ["md", "markdown"],
    "text": ["txt", "text", "log"],
    "html": ["html", "htm"],
    "python": ["py", "pyw"],
    "javascript": ["js", "jsx", "ts", "tsx", "mjs"],
    "yaml": ["yaml", "yml"],
    "json": ["json"],
    "image": ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif", "heic", "heif"],
    "audio": ["mp3", "wav", "m4a", "flac", "ogg", "aac", "wma", "opus", "aiff"],
}
SKIPPED_FOLDERS = ["node_modules", "__pycache__", ".git", "venv", "env", ".venv", "Windows", "Program Files", "Program Files (x86)", "$Recycle.Bin", "System Volume Information", ".cache", ".local", ".config", "snap", "AppData", "ProgramData", ".npm", ".yarn", "site-packages", "dist-packages"]

# Renamed entity labels, discovery types of patterns, file-name rules, excluded names.
LABELS = {"PERSON": "PERSON", "ORG": "ORG", "GPE": "LOCATION", "LOC": "LOCATION", "DATE": "DATE", "TIME": "TIME", "MONEY": "MONEY", "PRODUCT": "PRODUCT", "WORK_OF_ART": "PROJECT", "LAW": "LEGAL", "EVENT": "EVENT"}
DISCOVERY_TYPES = {"expertise": "expertise", "relationship": "relationship", "workflow": "workflow", "heuristic": "skill"}
NAMING = {"date_prefix": r"\d{4}[-_]?\d{2}[-_]?\d{2}", "versioned": r"(?i)v\d+|_v\d+|version", "status_suffix": r"(?i)draft|final|wip", "project_prefix": r"^[A-Z]{2,5}[-_]"}
EXCLUDED_PATHS = ["**/node_modules/**", "**/.git/**", "**/venv/**", "**/__pycache__/**", "**/AppData/**", "**/$RECYCLE.BIN/**"]
EXCLUDED_NAMES = ["*.tmp", "*.log", "*.bak", "Thumbs.db", "desktop.ini", ".DS_Store"]

# Entity expressions with Unicode classes spelled out, and how many matches of a text count.
ENTITY_RULES = {
    "EMAIL": (r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+", 10),
    "URL": (r'https?://[^\s<>"]+', 10),
    "PATH": (r"[A-Z]:\\[\p{L}\p{N}_\\.-]+|/[\p{L}\p{N}_/.-]+", 10),
    "DATE": (r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}", 10),
    "PROPER_NOUN": (r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 20),
}
