"""Word lists, thresholds and labels that results depend on."""

# Fixed values, in their fixed order.
NOISE = (
    "funding", "series", "seed round", "raises", "raised", "investment", "valuation", "acquired", "acquisition", "merger", "ipo", "earnings", "revenue", "quarter", "profit", "loss",
    "pricing", "subscription", "plan", "billing", "product update", "feature update", "release notes", "roadmap", "partnership", "collaboration", "conference", "summit", "webinar",
    "hackathon", "sponsor", "hiring", "job opening", "careers", "appointed", "joins as", "ceo", "cto", "cfo", "award", "community update", "policy update", "terms of service",
    "privacy policy", "融资", "估值", "收购", "并购", "发布会", "合作", "招聘", "岗位", "公告", "政策", "服务条款", "隐私政策",
)
CAPABILITY = (
    "benchmark", "state of the art", "sota", "accuracy", "score", "outperforms", "surpasses", "achieves", "generalization", "reasoning", "planning", "agent", "autonomous", "multimodal",
    "vision", "language", "training", "model", "architecture", "scaling", "parameters", "evaluation", "dataset", "paper", "arxiv", "preprint", "novel", "algorithm", "compute",
    "capability", "performance", "human-level", "superhuman", "arc", "mmlu", "gpqa", "swe-bench", "gsm8k", "hellaswag", "imagenet", "big-bench", "基准", "评测", "准确率", "得分", "性能",
    "泛化", "推理", "规划", "多模态", "模型", "架构", "训练", "参数", "数据集", "论文", "预印本", "算法", "能力", "人类水平",
)
EVIDENCE = (
    "state of the art", "sota", "outperforms", "surpasses", "beats", "achieves", "improves", "improvement", "benchmark", "human-level", "generalization", "emergent", "novel",
    "breakthrough", "基准", "评测", "人类水平", "泛化", "涌现", "突破", "新方法", "新架构",
)
BENCHMARKS = {
    "arc": "ARC", "arc-agi": "ARC-AGI", "mmlu": "MMLU", "gpqa": "GPQA", "swe-bench": "SWE-bench", "imagenet": "ImageNet", "glue": "GLUE", "superglue": "SuperGLUE",
    "hellaswag": "HellaSwag", "gsm8k": "GSM8K", "math": "MATH", "big-bench": "BIG-bench",
}
METRICS = ("accuracy", "score", "pass@1", "pass@k", "f1", "f1-score", "bleu", "map", "mrr", "em")
SECRECY = (
    "cannot discuss", "classified", "confidential", "under review", "embargo", "restricted", "private briefing", "closed door", "non-disclosure", "nda", "internal only",
    "not for public", "redacted", "removed at request", "taken down", "withdrawn",
)
CAUTION = (
    "proceed with caution", "safety concerns", "alignment concerns", "pausing development", "slowing down", "careful consideration", "responsible disclosure", "staged release",
    "limited access", "controlled rollout",
)
GOVERNMENT = (
    "executive order", "congressional briefing", "senate hearing", "classified meeting", "national security", "defense department", "intelligence agency", "regulatory review",
    "government consultation", "policy briefing",
)
DEPARTURE = ("leaving", "departing", "stepping down", "resigned", "left the company", "no longer with", "joined another", "new venture")
SENIOR = ("chief scientist", "head of ai", "research director", "vp of research", "lead researcher", "principal scientist", "cto", "chief technology")
CRITICAL_TERMS = ("classified", "redacted", "removed at request")
HIGH_TERMS = ("confidential", "non-disclosure", "nda", "private briefing")
DAYS_BETWEEN_PUBLICATIONS = {"OpenAI Blog": 14, "DeepMind Research": 21, "Anthropic Blog": 14, "Microsoft AI Blog": 7, "Google AI Blog": 7, "arXiv AI": 1}
USUAL_DAYS = 14
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid", "mc_cid", "mc_eid")
SEVERITIES = ("none", "low", "medium", "high", "critical")
# End of fixed values.
