"""Tables of paper types and fields."""

from __future__ import annotations

# Labels, keywords and their order decide the results.

TYPE_CHAIN = [
    ("review", ["systematic review", "literature review", "meta-analysis", "review of"]),
    ("theoretical", ["theoretical framework", "theoretical model", "conceptual framework", "theoretical analysis"]),
    ("case_study", ["case study", "case analysis", "specific case", "case-based"]),
    ("comparative", ["comparative analysis", "comparison between", "versus", "compared to", "comparative study"]),
    ("analytical", ["critical analysis", "analytical framework", "analytical study", "analysis of"]),
    ("methodological", ["methodology development", "methodological approach", "method innovation", "procedural"]),
    ("position", ["position paper", "opinion paper", "viewpoint", "stance on", "argument for"]),
    ("technical", ["technical implementation", "technical analysis", "system architecture", "technical report"]),
    ("interdisciplinary", ["interdisciplinary", "cross-disciplinary", "multi-disciplinary", "interdisciplinary approach"]),
]
FIELD_CHAIN = [
    ("medicine", ["medical", "health", "clinical", "patient", "disease", "diagnosis", "treatment"]),
    ("social_sciences", ["social", "behavior", "psychology", "sociology", "human behavior"]),
    ("business", ["business", "management", "economics", "finance", "market", "enterprise"]),
    ("education", ["education", "learning", "teaching", "pedagogy", "academic"]),
]
CONTENT_TYPES = {
    "empirical": ["experiment", "study", "participants", "data collection", "results", "statistical analysis", "survey", "interview"],
    "theoretical": ["theory", "framework", "conceptual", "model", "proposition", "theoretical foundation"],
    "review": ["literature review", "systematic review", "meta-analysis", "previous studies", "existing research", "overview"],
    "comparative": ["comparison", "compare", "versus", "contrast", "different", "similarities", "differences"],
    "case_study": ["case study", "case analysis", "specific case", "real-world", "practical example"],
    "analytical": ["analysis", "analytical", "critical analysis", "examination", "investigation", "evaluation"],
    "methodological": ["methodology", "method", "approach", "technique", "procedure", "methodological framework"],
    "position": ["position", "argument", "perspective", "viewpoint", "stance", "proposal"],
    "technical": ["technical", "implementation", "algorithm", "system design", "technical specification"],
    "interdisciplinary": ["interdisciplinary", "multidisciplinary", "cross-disciplinary", "integration", "collaboration"],
}
CONTENT_FIELDS = {
    "computer_science": ["algorithm", "programming", "software", "data", "machine learning", "artificial intelligence", "computer", "computing"],
    "medicine": ["clinical", "patient", "treatment", "medical", "healthcare", "diagnosis", "therapy", "disease"],
    "social_sciences": ["social", "behavior", "society", "human", "sociology", "psychology", "anthropology"],
    "engineering": ["engineering", "technical", "system", "design", "mechanical", "electrical", "civil"],
    "humanities": ["philosophy", "literature", "history", "culture", "art", "language", "humanities"],
    "physics": ["physics", "quantum", "particle", "energy", "force", "matter", "universe"],
    "chemistry": ["chemistry", "chemical", "molecule", "reaction", "compound", "element"],
    "biology": ["biology", "biological", "organism", "cell", "gene", "evolution", "species"],
    "economics": ["economics", "economic", "market", "finance", "trade", "business", "economy"],
    "psychology": ["psychology", "psychological", "behavior", "cognitive", "mental", "brain", "mind"],
}
TOPIC_TYPES = {
    "empirical": ["experiment", "study", "participants", "data collection", "results", "statistical analysis", "hypothesis", "sample size", "survey", "interview", "observation", "measurement", "correlation"],
    "theoretical": ["theory", "framework", "conceptual", "model", "proposition", "hypothesis", "theoretical foundation", "conceptual framework", "theoretical analysis", "theoretical implications"],
    "review": ["literature review", "systematic review", "meta-analysis", "previous studies", "existing research", "overview", "comprehensive review", "state of the art"],
    "comparative": ["comparison", "compare", "versus", "contrast", "different", "similarities", "differences", "analysis of", "evaluation of"],
    "case_study": ["case study", "case analysis", "specific case", "real-world", "practical example", "implementation", "case-based"],
    "analytical": ["analysis", "analytical", "critical analysis", "examination", "investigation", "evaluation", "assessment", "detailed analysis"],
    "methodological": ["methodology", "method", "approach", "technique", "procedure", "methodological framework", "research design", "methodological analysis"],
    "position": ["position", "argument", "perspective", "viewpoint", "stance", "proposal", "recommendation", "advocacy", "position paper"],
    "technical": ["technical", "implementation", "algorithm", "system design", "technical specification", "technical analysis", "technical solution"],
    "interdisciplinary": ["interdisciplinary", "multidisciplinary", "cross-disciplinary", "integration", "collaboration", "multiple fields", "diverse approaches"],
}
INDICATORS = {
    "specificity": ["algorithm", "methodology", "framework", "model", "theory"],
    "methodology": ["method", "approach", "technique", "procedure", "design"],
    "analysis": ["analysis", "examination", "investigation", "evaluation", "assessment"],
}
FIELD_HINTS = [["algorithm", "programming", "software", "data"], ["clinical", "patient", "treatment", "medical"], ["social", "behavior", "society", "human"], ["engineering", "technical", "system", "design"]]
APPROACH_HINTS = [["statistical", "numerical", "data", "measurement"], ["interview", "observation", "narrative", "descriptive"], ["both", "combination", "integrated", "mixed methods"]]
PARAPHRASES = [("study", "research"), ("analysis", "examination"), ("results", "findings"), ("method", "approach"), ("data", "information"), ("shows", "demonstrates"), ("found", "discovered"), ("important", "significant")]
ABBREVIATIONS = [("machine learning", "ML"), ("artificial intelligence", "AI"), ("deep learning", "DL"), ("neural networks", "NN"), ("natural language processing", "NLP"), ("computer vision", "CV"), ("reinforcement learning", "RL")]
STOCK_PHRASES = ["this study", "research shows", "according to", "in conclusion", "furthermore", "however", "the results indicate", "previous studies", "literature review", "methodology"]
GUIDANCE = {
    "empirical": ("Data-driven with statistical analysis", ["Methodology", "Results", "Discussion"]),
    "theoretical": ("Conceptual with framework development", ["Theoretical Framework", "Analysis", "Discussion"]),
    "review": ("Synthetic with gap identification", ["Literature Review", "Analysis", "Discussion"]),
    "comparative": ("Comparative with systematic contrast", ["Comparative Analysis", "Discussion"]),
    "case_study": ("Narrative with rich context", ["Case Background", "Case Analysis", "Discussion"]),
    "analytical": ("Critical with logical reasoning", ["Analytical Framework", "Analysis", "Discussion"]),
    "methodological": ("Procedural with innovation focus", ["Methodology Development", "Validation", "Discussion"]),
    "position": ("Persuasive with clear stance", ["Position Statement", "Supporting Arguments", "Discussion"]),
    "technical": ("Technical with implementation focus", ["Technical Background", "Technical Analysis", "Results"]),
    "interdisciplinary": ("Integrative with multi-disciplinary approach", ["Theoretical Integration", "Cross-Disciplinary Analysis", "Discussion"]),
}
REWRITE_MODES = ["Standard rewrite", "Reduce plagiarism", "Improve clarity", "Academic tone", "Simplify", "Shorten", "Expand"]
FRAMEWORKS = {"rtf": ["Role", "Task", "Format"], "crispe": ["Capacity", "Insight", "Statement", "Personality", "Experiment"], "chain": ["Role", "Task", "Reasoning", "Answer"], "few_shot": ["Role", "Task", "Examples", "Request", "Format"], "contract": ["Role", "Objective", "Context", "Constraints", "Output format", "Acceptance criteria"]}
