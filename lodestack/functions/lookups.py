"""Tables that must be as they are for equal results. Operators take any table of the same shape."""

from __future__ import annotations

# Chinese research terms and what they are called in English.
CHINESE_TERMS = {
    "大语言模型": "large language model llm", "语言模型": "language model", "扩散模型": "diffusion model", "生成模型": "generative model",
    "强化学习": "reinforcement learning", "深度学习": "deep learning", "机器学习": "machine learning", "迁移学习": "transfer learning",
    "联邦学习": "federated learning", "对比学习": "contrastive learning", "自监督": "self-supervised learning", "图神经网络": "graph neural network gnn",
    "卷积神经网络": "convolutional neural network cnn", "神经网络": "neural network", "注意力机制": "attention mechanism", "变换器": "transformer",
    "计算机视觉": "computer vision", "目标检测": "object detection", "语义分割": "semantic segmentation", "图像分类": "image classification",
    "图像分割": "image segmentation", "图像生成": "image generation", "自然语言处理": "natural language processing nlp", "机器翻译": "machine translation",
    "文本生成": "text generation", "问答系统": "question answering", "检索增强生成": "retrieval augmented generation rag", "知识图谱": "knowledge graph",
    "知识图谱补全": "knowledge graph completion", "推荐系统": "recommender system recommendation", "推荐算法": "recommendation algorithm",
    "异常检测": "anomaly detection", "时间序列": "time series", "因果推断": "causal inference", "可解释": "explainable interpretability", "联邦": "federated",
    "量子计算": "quantum computing", "量子": "quantum", "蛋白质结构预测": "protein structure prediction", "蛋白质": "protein", "基因": "gene genomic",
    "药物发现": "drug discovery", "新药": "drug discovery", "疫苗": "vaccine", "新冠": "covid sars-cov-2", "癌症": "cancer tumor", "单细胞": "single cell",
    "锂电池": "lithium battery", "电池": "battery", "太阳能电池": "solar cell photovoltaic", "钙钛矿": "perovskite", "催化": "catalysis catalyst",
    "材料发现": "materials discovery", "半导体": "semiconductor", "超导": "superconductor", "纳米": "nano", "生成对抗网络": "generative adversarial network gan",
    "多模态": "multimodal", "预训练": "pretraining pretrained", "微调": "fine-tuning", "提示工程": "prompt engineering", "思维链": "chain of thought reasoning",
    "智能体": "agent autonomous agent", "多智能体": "multi-agent", "情感分析": "sentiment analysis", "命名实体识别": "named entity recognition ner",
    "文本分类": "text classification", "聚类": "clustering", "降维": "dimensionality reduction", "超分辨率": "super resolution", "人脸识别": "face recognition",
    "姿态估计": "pose estimation", "自动驾驶": "autonomous driving self-driving", "语音识别": "speech recognition", "脑机接口": "brain computer interface",
    "医学影像": "medical imaging", "影像分割": "image segmentation", "电子健康记录": "electronic health record ehr", "蛋白质设计": "protein design",
    "分子生成": "molecular generation", "材料基因组": "materials genome", "储能": "energy storage", "燃料电池": "fuel cell", "气候变化": "climate change",
    "遥感": "remote sensing", "区块链": "blockchain", "边缘计算": "edge computing", "隐私保护": "privacy preserving differential privacy", "对抗攻击": "adversarial attack",
}

# Concepts, and the phrases of a normalised text that signal them.
CONCEPT_PHRASES = {
    "artificial intelligence": ("artificial intelligence", "ai"),
    "battery": ("battery", "batteries", "lithium ion"),
    "biomedical nlp": ("biomedical nlp", "biomedical natural language processing", "clinical nlp"),
    "cancer": ("cancer", "tumor", "tumour", "oncology"),
    "catalyst discovery": ("catalyst discovery", "catalytic discovery", "catalyst design"),
    "clinical search": ("clinical search", "clinical retrieval"),
    "computational biology": ("computational biology", "bioinformatics"),
    "covid 19": ("covid19", "covid 19", "sars cov 2"),
    "data science": ("data science",),
    "deep learning": ("deep learning", "deep neural network", "deep neural networks"),
    "diffusion model": ("diffusion model", "diffusion models", "denoising diffusion"),
    "drug discovery": ("drug discovery", "drug design", "drug repurposing"),
    "graph neural network": ("graph neural network", "graph neural networks", "gnn", "gnns"),
    "information retrieval": ("information retrieval", "neural retrieval"),
    "knowledge graph": ("knowledge graph", "knowledge graphs", "knowledge graph embedding", "knowledge graph embeddings"),
    "large language model": ("large language model", "large language models", "llm", "llms", "foundation model", "foundation models"),
    "machine learning": ("machine learning",),
    "materials informatics": ("materials informatics", "material informatics", "materials discovery"),
    "multimodal learning": ("multimodal learning", "multimodal model", "multimodal models", "multimodal large language model", "multimodal large language models"),
    "nanotechnology": ("nanotechnology", "nanomaterial", "nanomaterials"),
    "natural language processing": ("natural language processing", "nlp"),
    "prompt engineering": ("prompt engineering", "prompt tuning", "instruction tuning"),
    "question answering": ("question answering", "qa system", "qa systems"),
    "retrieval augmented generation": ("retrieval augmented generation", "retrieval augmentation", "retrieval augmented", "rag"),
    "transformer": ("transformer", "transformers", "transformer based"),
    "vision language model": ("vision language model", "vision language models", "vision language pretraining", "vlm", "vlms"),
}

# Preprint categories with domain, field and subfield, and what is known of a category by its archive alone.
CATEGORY_TAXA = {
    "cs.ai": ("Computer Science", "Artificial Intelligence", "Artificial Intelligence"),
    "cs.cl": ("Computer Science", "Artificial Intelligence", "Natural Language Processing"),
    "cs.cv": ("Computer Science", "Artificial Intelligence", "Computer Vision"),
    "cs.lg": ("Computer Science", "Artificial Intelligence", "Machine Learning"),
    "cs.ir": ("Computer Science", "Information Systems", "Information Retrieval"),
    "cs.cr": ("Computer Science", "Security", "Computer Security"),
    "cs.ro": ("Computer Science", "Robotics", "Robotics"),
    "cond-mat.mtrl-sci": ("Physical Sciences", "Materials Science", "Materials Science"),
    "q-bio.qm": ("Life Sciences", "Computational Biology", "Quantitative Methods"),
    "q-bio.gn": ("Life Sciences", "Computational Biology", "Genomics"),
    "q-bio.nc": ("Life Sciences", "Computational Biology", "Neurons and Cognition"),
    "stat.ml": ("Computer Science", "Statistics", "Statistical Machine Learning"),
    "stat.me": ("Physical Sciences", "Statistics", "Statistical Methods"),
    "eess.iv": ("Computer Science", "Electrical Engineering", "Image and Video Processing"),
}
ARCHIVE_TAXA = {
    "cs": ("Computer Science", "Computer Science"),
    "q-bio": ("Life Sciences", "Computational Biology"),
    "cond-mat": ("Physical Sciences", "Materials Science"),
    "stat": ("Physical Sciences", "Statistics"),
    "eess": ("Computer Science", "Electrical Engineering"),
    "math": ("Physical Sciences", "Mathematics"),
}
OTHER_ARCHIVE = ("Physical Sciences", "Physics")

# Word parts of subject headings, in the order in which they decide, with domain and field.
SUBJECT_RULES = (
    (("computer", "information technology", "electronic"), "Computer Science", "Computer Science"),
    (("medicine", "medical", "public health", "health"), "Health Sciences", "Medicine"),
    (("biology", "biological", "genetics", "life sciences"), "Life Sciences", "Biology"),
    (("material", "nanomaterial", "chemical technology", "engineering"), "Physical Sciences", "Materials Science"),
    (("physics", "chemistry", "mathematics", "science"), "Physical Sciences", "Physical Sciences"),
    (("social", "education", "economics", "law", "political"), "Social Sciences", "Social Sciences"),
)
GENERIC_SUBFIELDS = ("article", "humans", "male", "female", "adult", "study", "method", "methods")

# Filler of questions, in the order in which it is taken out; words that ask for what is new.
CHINESE_FILLER = (
    "请帮我", "帮我", "给我", "我想知道", "我想看看", "我想看", "告诉我", "麻烦", "推荐一下", "推荐", "介绍一下", "介绍", "列举", "列出", "找一下", "查一下",
    "最新的", "最新", "最近的", "最近", "一篇", "几篇", "一些", "一下", "若干", "有哪些", "是什么", "怎么样", "的研究", "的论文", "的文献", "论文", "文献", "请问", "请",
)
ENGLISH_FILLER = (
    "recommend a paper on", "recommend a paper about", "a paper on", "papers on", "paper about", "papers about", "tell me about", "give me", "show me", "find me",
    "what are", "recommend", "please", "latest", "recent", "list",
)
RECENCY_WORDS = ("最新", "最近", "近期", "今年", "newest", "latest", "recent", "most recent")

# Phrases that a term of a question stands for, and what hits in each field of a paper count.
SPECIAL_PHRASES = {"rag": "retrieval augmented generation"}
FIELD_WEIGHTS = {"title": (60, 4), "keywords": (50, 4), "abstract": (20, 3), "full_text": (10, 2)}
