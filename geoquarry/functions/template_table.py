"""Chat templates as data.

Most dialects put each turn into a frame: an opening with the role's name,
the text, a closing, and at last the opening of the answer. ``framed`` makes
the slots from that rule; the rest are stated slot by slot. ``{bos}`` and
``{eos}`` stand for the tokenizer's own tokens. All strings are fixed values.
"""

from __future__ import annotations

C = "{{content}}"


def framed(opening: str, closing: str, user: str = "user", answer: str = "assistant", system: str = "system", tool: str | None = "tool", after: str = "") -> dict[str, str]:
    """Slots of a dialect with frames; ``after`` stands between a closing and the next opening."""
    turn = lambda role: opening.replace("{role}", role) + C + closing + after
    lead = opening.replace("{role}", answer)
    slots = {"user": turn(user) + lead, "assistant": C + closing + after, "system": turn(system)}
    return slots | ({"observation": turn(tool) + lead} if tool else {})


CHATML = framed("<|im_start|>{role}\n", "<|im_end|>", after="\n")
PLAIN = {k: v for k, v in CHATML.items() if k != "observation"}
QWEN = PLAIN | {"observation": "<|im_start|>user\n<tool_response>\n" + C + "\n</tool_response><|im_end|>\n<|im_start|>assistant\n", "tool_format": "qwen", "stop_words": ("<|im_end|>",), "replace_eos": True}
LLAMA3 = framed("<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", tool="ipython") | {"tool_format": "llama3", "prefix": "{bos}", "stop_words": ("<|eot_id|>", "<|eom_id|>")}
LLAMA4 = framed("<|header_start|>{role}<|header_end|>\n\n", "<|eot|>", tool="ipython") | {"tool_format": "llama3", "prefix": "{bos}", "stop_words": ("<|eot|>", "<|eom|>"), "replace_eos": True}
LLAMA2 = {"user": "{bos}[INST] " + C + " [/INST]", "system": "<<SYS>>\n" + C + "\n<</SYS>>\n\n", "system_in_user": True}
GEMMA = framed("<start_of_turn>{role}\n", "<end_of_turn>", answer="model", after="\n") | {"system": C + "\n\n", "prefix": "{bos}", "system_in_user": True}
GLM4 = {"user": "<|user|>\n" + C + "<|assistant|>", "assistant": "\n" + C, "system": "<|system|>\n" + C, "function": C, "observation": "<|observation|>\n" + C + "<|assistant|>", "tool_format": "glm4", "prefix": "[gMASK]<sop>", "stop_words": ("<|user|>", "<|observation|>"), "efficient_eos": True}
MISTRAL = {"user": "[INST] " + C + "[/INST]", "assistant": " " + C + "{eos}", "system": C + "\n\n", "function": "[TOOL_CALLS] " + C + "{eos}", "observation": '[TOOL_RESULTS] {"content": ' + C + "}[/TOOL_RESULTS]", "tool_format": "mistral", "prefix": "{bos}", "system_in_user": True}
MINISTRAL = {"user": "[INST]" + C + "[/INST]", "system": C + "\n\n", "function": "[TOOL_CALLS]" + C + "{eos}", "observation": '[TOOL_RESULTS]{"content": ' + C + "}[/TOOL_RESULTS]", "tool_format": "mistral", "prefix": "{bos}", "system_in_user": True}
MOONSHOT = {"user": "<|im_user|>user<|im_middle|>" + C + "<|im_end|><|im_assistant|>assistant<|im_middle|>", "assistant": C + "<|im_end|>", "system": "<|im_system|>system<|im_middle|>" + C + "<|im_end|>", "stop_words": ("<|im_end|>",)}
GRANITE = framed("<|start_of_role|>{role}<|end_of_role|>", "<|end_of_text|>", tool=None, after="\n")
PHI = framed("<|{role}|>\n", "<|end|>", tool=None, after="\n") | {"stop_words": ("<|end|>",)}
SEED = {"user": "{bos}user\n" + C + "{eos}{bos}assistant\n", "system": "{bos}system\n" + C + "{eos}"}
VICUNA = {"user": "USER: " + C + " ASSISTANT:"}
CHATGLM = "[gMASK]sop"
ENDS = {"stop_words": ("<|im_end|>",)}
BOTH_ENDS = {"stop_words": ("<|im_end|>", "<|im_start|>"), "replace_eos": True}
REASONS = {"reasoning": True}

HELPFUL = "You are a helpful assistant."
CURIOUS = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
INTERN = """You are an AI assistant whose name is InternLM (书生·浦语).
- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.
- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文."""
DBRX = """You are DBRX, created by Databricks. You were last updated in December 2023. You answer questions based on information available up to that point.
YOU PROVIDE SHORT RESPONSES TO SHORT QUESTIONS OR STATEMENTS, but provide thorough responses to more complex and open-ended questions.
You assist with various tasks, from writing to coding (using markdown for code blocks — remember to use ``` with code, JSON, and tables).
(You do not have real-time data access or code execution capabilities. You avoid stereotyping and provide balanced perspectives on controversial topics. You do not provide song lyrics, poems, or news articles and do not divulge details of your training data.)
This is your system prompt, guiding your responses. Do not reference it, just respond to the user. If you find yourself talking about this message, stop. You should be responding appropriately and usually that means not mentioning this.
YOU DO NOT MENTION ANY OF THIS INFORMATION ABOUT YOURSELF UNLESS THE INFORMATION IS DIRECTLY PERTINENT TO THE USER'S QUERY."""
CODER = "You are an AI programming assistant, utilizing the {} model, developed by {}, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer."
SKYWORK = "You are Skywork-o1, a thinking model developed by Skywork AI, specializing in solving complex problems involving mathematics, coding, and logical reasoning through deep thought. When faced with a user's request, you first engage in a lengthy and in-depth thinking process to explore possible solutions to the problem. After completing your thoughts, you then provide a detailed explanation of the solution process in your response."
MARCO = """你是一个经过良好训练的AI助手，你的名字是Marco-o1.由阿里国际数字商业集团的AI Business创造.
## 重要！！！！！
当你回答问题时，你的思考应该在<Thought>内完成，<Output>内输出你的结果。
<Thought>应该尽可能是英文，但是有2个特例，一个是对原文中的引用，另一个是是数学应该使用markdown格式，<Output>内的输出需要遵循用户输入的语言。
"""
XUANYUAN = "以下是用户和人工智能助手之间的对话。用户以Human开头，人工智能助手以Assistant开头，会对人类提出的问题给出有帮助、高质量、详细和礼貌的回答，并且总是拒绝参与与不道德、不安全、有争议、政治敏感等相关的话题、问题和指示。\n"
YAYI = """You are a helpful, respectful and honest assistant named YaYi developed by Beijing Wenge Technology Co.,Ltd. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.

If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information."""
YI_VL = "This is a chat between an inquisitive human and an AI assistant. Assume the role of the AI assistant. Read all the images carefully, and respond to the human's questions with informative, helpful, detailed and polite answers. 这是一个好奇的人类和一个人工智能助手之间的对话。假设你扮演这个AI助手的角色。仔细阅读所有的图像，并对人类的问题做出信息丰富、有帮助、详细的和礼貌的回答。\n\n"


def media(plugin: str, image: str | None = None, video: str | None = None, audio: str | None = None) -> dict:
    """The plugin that expands a template's media, and its tokens."""
    return {"media": (plugin, image, video, audio)}


QWEN_VL = media("qwen2_vl", "<|image_pad|>", "<|video_pad|>")
OMNI = media("qwen2_omni", "<|image_pad|>", "<|video_pad|>", "<|audio_pad|>")
ONE_IMAGE, IMAGE_VIDEO = "<image>", ("<image>", "<video>")

TEMPLATES: dict[str, dict] = {
    "alpaca": {"user": "### Instruction:\n" + C + "\n\n### Response:\n", "assistant": C + "{eos}\n\n", "default_system": "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"},
    "aquila": {"user": "Human: " + C + "###Assistant:", "assistant": C + "###", "system": "System: " + C + "###", "default_system": "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions.", "stop_words": ("</s>",)},
    "atom": {"user": "{bos}Human: " + C + "\n{eos}{bos}Assistant:", "assistant": C + "\n{eos}"},
    "baichuan": {"user": "<reserved_102>" + C + "<reserved_103>", "efficient_eos": True},
    "baichuan2": {"user": "<reserved_106>" + C + "<reserved_107>", "efficient_eos": True},
    "bailing": {"user": "<role>HUMAN</role>" + C + "<role>ASSISTANT</role>", "system": "<role>SYSTEM</role>" + C, "observation": "<role>OBSERVATION</role>" + C + "<role>ASSISTANT</role>", "stop_words": ("<|endoftext|>",), "efficient_eos": True},
    "bailing_v2": framed("<role>{role}</role>", "<|role_end|>", "HUMAN", "ASSISTANT", "SYSTEM", None) | {"observation": "<role>OBSERVATION</role>\n<tool_response>\n" + C + "\n</tool_response><|role_end|><role>ASSISTANT</role>", "tool_format": "ling", "stop_words": ("<|endoftext|>",), "efficient_eos": True},
    "belle": {"user": "Human: " + C + "\n\nBelle: ", "assistant": C + "{eos}\n\n", "prefix": "{bos}"},
    "bluelm": {"user": "[|Human|]:" + C + "[|AI|]:"},
    "breeze": {"user": "[INST] " + C + " [/INST] ", "prefix": "{bos}", "efficient_eos": True},
    "chatglm2": {"user": "[Round {{idx}}]\n\n问：" + C + "\n\n答：", "prefix": CHATGLM, "efficient_eos": True},
    "chatglm3": {"user": "<|user|>\n" + C + "<|assistant|>", "assistant": "\n" + C, "system": "<|system|>\n" + C, "function": C, "observation": "<|observation|>\n" + C + "<|assistant|>", "tool_format": "glm4", "prefix": CHATGLM, "stop_words": ("<|user|>", "<|observation|>"), "efficient_eos": True},
    "chatml": CHATML | BOTH_ENDS,
    "chatml_de": CHATML | BOTH_ENDS | {"default_system": "Du bist ein freundlicher und hilfsbereiter KI-Assistent."},
    "codegeex2": {"prefix": CHATGLM},
    "codegeex4": {"user": "<|user|>\n" + C + "<|assistant|>\n", "system": "<|system|>\n" + C, "function": C, "observation": "<|observation|>\n" + C + "<|assistant|>\n", "tool_format": "glm4", "prefix": "[gMASK]<sop>", "default_system": "你是一位智能编程助手，你叫CodeGeeX。你会为用户回答关于编程、代码、计算机方面的任何问题，并提供格式规范、可以执行、准确安全的代码，并在必要时提供详细的解释。", "stop_words": ("<|user|>", "<|observation|>"), "efficient_eos": True},
    "cohere": {k: v for k, v in framed("<|START_OF_TURN_TOKEN|><|{role}_TOKEN|>", "<|END_OF_TURN_TOKEN|>", "USER", "CHATBOT", "SYSTEM", None).items() if k != "assistant"} | {"prefix": "{bos}"},
    "cpm": {"user": "<用户>" + C + "<AI>", "prefix": "{bos}"},
    "cpm3": CHATML | ENDS | {"prefix": "{bos}"},
    "cpm4": CHATML | ENDS | {"prefix": "{bos}"},
    "dbrx": CHATML | ENDS | {"default_system": DBRX, "replace_eos": True},
    "deepseek": {"user": "User: " + C + "\n\nAssistant:", "system": C + "\n\n", "prefix": "{bos}"},
    "deepseek3": {"user": "<｜User｜>" + C + "<｜Assistant｜>", "prefix": "{bos}"},
    "deepseekr1": {"user": "<｜User｜>" + C + "<｜Assistant｜>", "prefix": "{bos}"} | REASONS,
    "deepseekcoder": {"user": "### Instruction:\n" + C + "\n### Response:", "assistant": "\n" + C + "\n<|EOT|>\n", "prefix": "{bos}", "default_system": CODER.format("DeepSeek Coder", "DeepSeek Company") + "\n"},
    "default": {"user": "Human: " + C + "{eos}\nAssistant:", "assistant": C + "{eos}\n", "system": "System: " + C + "{eos}\n"},
    "dots_ocr": {"user": "<|user|>" + C + "<|endofuser|><|assistant|>", "assistant": C + "<|endofassistant|>", "system": "<|system|>" + C + "<|endofsystem|>\n", "stop_words": ("<|endofassistant|>",), "efficient_eos": True} | media("qwen2_vl", "<|imgpad|>", "<|vidpad|>"),
    "empty": {"assistant": C},
    "ernie": framed("<|im_start|>{role}\n", "<|im_end|>", after="\n\n") | ENDS | {"default_system": "<global_setting>\nthink_mode=True\n</global_setting>"},
    "ernie_nothink": {"user": "User: " + C + "\nAssistant: ", "assistant": C + "<|end_of_sentence|>", "system": C + "\n", "prefix": "<|begin_of_sentence|>", "stop_words": ("<|end_of_sentence|>",)},
    "exaone": {"user": "[|user|]" + C + "\n[|assistant|]", "assistant": C + "{eos}\n", "system": "[|system|]" + C + "[|endofturn|]\n"},
    "falcon": {"user": "User: " + C + "\nFalcon:", "assistant": C + "\n", "efficient_eos": True},
    "falcon_h1": CHATML | {"prefix": "{bos}", "stop_words": ("<|im_end|>", "<|end_of_text|>")},
    "fewshot": {"assistant": C + "\n\n", "efficient_eos": True},
    "gemma": GEMMA | {"stop_words": ("<end_of_turn>",), "replace_eos": True},
    "gemma2": GEMMA | {"stop_words": ("<eos>", "<end_of_turn>"), "efficient_eos": True},
    "gemma3": GEMMA | {"stop_words": ("<end_of_turn>",), "replace_eos": True} | media("gemma3", "<image_soft_token>"),
    "gemma3n": GEMMA | {"stop_words": ("<end_of_turn>",), "replace_eos": True} | media("gemma3n", "<image_soft_token>", None, "<audio_soft_token>"),
    "glm4": GLM4,
    "glm4_moe": GLM4 | REASONS | {"tool_format": "glm4_moe"},
    "glm4v": GLM4 | REASONS | {"stop_words": ("<|user|>", "<|observation|>", "</answer>")} | media("glm4v", "<|image|>", "<|video|>"),
    "glm4v_moe": GLM4 | REASONS | {"tool_format": "glm4_moe", "stop_words": ("<|user|>", "<|observation|>", "</answer>")} | media("glm4v", "<|image|>", "<|video|>"),
    "glmz1": GLM4 | REASONS,
    "gpt": {"user": "<|start|>user<|message|>" + C + "<|end|><|start|>assistant", "assistant": C + "<|end|>", "system": "<|start|>system<|message|>" + C + "<|end|>", "default_system": "You are ChatGPT, a large language model trained by OpenAI.", "thought_words": ("<|channel|>analysis<|message|>", "<|end|><|start|>assistant<|channel|>final<|message|>"), "efficient_eos": True} | REASONS,
    "granite3": GRANITE,
    "granite3_vision": {"user": "<|user|>\n" + C + "\n<|assistant|>\n", "system": "<|system|>\n" + C + "\n", "default_system": CURIOUS} | media("llava_next", ONE_IMAGE),
    "granite4": GRANITE | {"observation": "<|start_of_role|>tool<|end_of_role|>" + C + "<|end_of_text|>\n<|start_of_role|>assistant\n", "stop_words": ("<|end_of_text|>",), "default_system": "You are Granite, developed by IBM. You are a helpful AI assistant."},
    "index": {"user": "reserved_0" + C + "reserved_1", "system": "<unk>" + C, "efficient_eos": True},
    "hunyuan": {"user": C + "<|extra_0|>", "assistant": C + "<|eos|>", "system": C + "<|extra_4|>", "prefix": "<|startoftext|>", "stop_words": ("<|eos|>",)},
    "intern": {"user": "<|User|>:" + C + "\n<|Bot|>:", "assistant": C + "<eoa>\n", "system": "<|System|>:" + C + "\n", "prefix": "{bos}", "default_system": INTERN, "stop_words": ("<eoa>",)},
    "intern2": PLAIN | ENDS | {"prefix": "{bos}", "default_system": INTERN},
    "intern_vl": PLAIN | ENDS | {"prefix": "{bos}", "default_system": "你是书生·万象，英文名是InternVL，是由上海人工智能实验室、清华大学及多家合作单位联合开发的多模态大语言模型。"} | media("intern_vl", *IMAGE_VIDEO),
    "intern_s1": PLAIN | ENDS | {"prefix": "{bos}"} | media("intern_vl", *IMAGE_VIDEO),
    "keye_vl": QWEN | REASONS | QWEN_VL,
    "kimi_vl": MOONSHOT | REASONS | {"default_system": "You are a helpful assistant", "thought_words": ("◁think▷", "◁/think▷")} | media("kimi_vl", "<|media_pad|>"),
    "llama2": LLAMA2,
    "llama2_zh": LLAMA2 | {"default_system": "You are a helpful assistant. 你是一个乐于助人的助手。"},
    "llama3": LLAMA3 | {"replace_eos": True},
    "llama4": LLAMA4 | media("llama4", "<|image|>"),
    "mllama": LLAMA3 | {"replace_eos": True} | media("mllama", "<|image|>"),
    "moonlight": MOONSHOT | {"default_system": "You are a helpful assistant provided by Moonshot-AI.", "replace_eos": True},
    "llava": VICUNA | {"default_system": CURIOUS} | media("llava", ONE_IMAGE),
    "llava_next": VICUNA | {"default_system": CURIOUS} | media("llava_next", ONE_IMAGE),
    "llava_next_llama3": LLAMA3 | {"replace_eos": True} | media("llava_next", ONE_IMAGE),
    "llava_next_mistral": MISTRAL | media("llava_next", ONE_IMAGE),
    "llava_next_qwen": QWEN | {"default_system": HELPFUL} | media("llava_next", ONE_IMAGE),
    "llava_next_yi": PLAIN | ENDS | media("llava_next", ONE_IMAGE),
    "llava_next_video": VICUNA | {"default_system": CURIOUS} | media("llava_next_video", *IMAGE_VIDEO),
    "llava_next_video_mistral": MISTRAL | media("llava_next_video", *IMAGE_VIDEO),
    "llava_next_video_yi": PLAIN | ENDS | media("llava_next_video", *IMAGE_VIDEO),
    "marco": CHATML | ENDS | {"default_system": MARCO},
    "mimo": QWEN | REASONS | {"default_system": HELPFUL},
    "mimo_vl": QWEN | REASONS | QWEN_VL | {"default_system": "You are MiMo, an AI assistant developed by Xiaomi."},
    "minicpm_v": PLAIN | ENDS | {"default_system": HELPFUL} | media("minicpm_v", *IMAGE_VIDEO),
    "minicpm_o": PLAIN | ENDS | {"default_system": "You are a helpful assistant. You can accept audio and text input and output voice and text."} | media("minicpm_v", *IMAGE_VIDEO, "<audio>"),
    "ministral": MINISTRAL,
    "mistral": MISTRAL,
    "mistral_small": MINISTRAL | {"system": "[SYSTEM_PROMPT]" + C + "[/SYSTEM_PROMPT]", "system_in_user": False} | media("pixtral", "[IMG]"),
    "olmo": {"user": "<|user|>\n" + C + "<|assistant|>\n", "prefix": "{eos}"},
    "openchat": {"user": "GPT4 Correct User: " + C + "{eos}GPT4 Correct Assistant:", "prefix": "{bos}"},
    "openchat-3.6": {"user": "<|start_header_id|>GPT4 Correct User<|end_header_id|>\n\n" + C + "<|eot_id|><|start_header_id|>GPT4 Correct Assistant<|end_header_id|>\n\n", "prefix": "{bos}", "stop_words": ("<|eot_id|>",)},
    "opencoder": CHATML | ENDS | {"default_system": "You are OpenCoder, created by OpenCoder Team."},
    "orion": {"user": "Human: " + C + "\n\nAssistant: {eos}", "prefix": "{bos}"},
    "paligemma": {"user": C + "\n", "prefix": "{bos}", "system_in_user": True} | media("paligemma", ONE_IMAGE),
    "paligemma_chat": {k: v for k, v in GEMMA.items() if k != "system"} | {"stop_words": ("<end_of_turn>",), "replace_eos": True} | media("paligemma", ONE_IMAGE),
    "phi": PHI | {"replace_eos": True},
    "phi_small": PHI | {"prefix": "<|endoftext|>", "replace_eos": True},
    "phi4": framed("<|im_start|>{role}<|im_sep|>", "<|im_end|>", tool=None) | ENDS | {"replace_eos": True},
    "pixtral": MINISTRAL | media("pixtral", "[IMG]"),
    "qwen": QWEN | {"default_system": "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."},
    "qwen3": QWEN | REASONS,
    "qwen3_nothink": QWEN,
    "qwen2_audio": PLAIN | ENDS | {"default_system": HELPFUL, "replace_eos": True} | media("qwen2_audio", None, None, "<|AUDIO|>"),
    "qwen2_omni": QWEN | {"default_system": HELPFUL} | media("qwen2_omni", "<|IMAGE|>", "<|VIDEO|>", "<|AUDIO|>"),
    "qwen3_omni": QWEN | REASONS | OMNI,
    "qwen3_omni_nothink": QWEN | OMNI,
    "qwen2_vl": QWEN | QWEN_VL | {"default_system": HELPFUL},
    "qwen3_vl": QWEN | REASONS | media("qwen3_vl", "<|image_pad|>", "<|video_pad|>"),
    "qwen3_vl_nothink": QWEN | media("qwen3_vl", "<|image_pad|>", "<|video_pad|>"),
    "sailor": framed("<|im_start|>{role}\n", "<|im_end|>", "question", "answer", tool=None, after="\n") | ENDS | {"default_system": "You are an AI assistant named Sailor created by Sea AI Lab. Your answer should be friendly, unbiased, faithful, informative and detailed."},
    "seed_coder": SEED | {"default_system": CODER.format("Seed-Coder", "ByteDance Seed") + "\n\n"},
    "seed_oss": SEED | REASONS | {"function": "{bos}\n" + C + "{eos}", "tool_format": "seed_oss", "thought_words": ("<seed:think>", "</seed:think>")},
    "skywork_o1": LLAMA3 | {"default_system": SKYWORK},
    "smollm": PLAIN | ENDS,
    "smollm2": PLAIN | ENDS | {"default_system": "You are a helpful AI assistant named SmolLM, trained by Hugging Face."},
    "solar": {"user": "### User:\n" + C + "\n\n### Assistant:\n", "system": "### System:\n" + C + "\n\n", "efficient_eos": True},
    "starchat": {"user": "<|user|>\n" + C + "<|end|>\n<|assistant|>", "assistant": C + "<|end|>\n", "system": "<|system|>\n" + C + "<|end|>\n", "stop_words": ("<|end|>",)},
    "telechat": {"user": "<_user>" + C + "<_bot>", "system": "<_system>" + C + "<_end>"},
    "telechat2": {"user": "<_user>" + C + "<_bot>", "system": "<_system>" + C, "default_system": "你是中国电信星辰语义大模型，英文名是TeleChat，你是由中电信人工智能科技有限公司和中国电信人工智能研究院（TeleAI）研发的人工智能助手。"},
    "vicuna": VICUNA | {"default_system": CURIOUS},
    "video_llava": VICUNA | {"default_system": CURIOUS} | media("video_llava", *IMAGE_VIDEO),
    "xuanyuan": {"user": "Human: " + C + " Assistant:", "default_system": XUANYUAN},
    "xverse": {"user": "Human: " + C + "\n\nAssistant: "},
    "yayi": {"user": "<|Human|>:\n" + C + "\n\n<|YaYi|>:", "assistant": C + "\n\n", "system": "<|System|>:\n" + C + "\n\n", "default_system": YAYI, "stop_words": ("<|End|>",)},
    "yi": PLAIN | ENDS,
    "yi_vl": {"user": "### Human: " + C + "\n### Assistant:", "assistant": C + "\n", "default_system": YI_VL, "stop_words": ("###",), "efficient_eos": True} | media("llava", ONE_IMAGE),
    "yuan": {"user": C + "<sep>", "assistant": C + "<eod>\n", "stop_words": ("<eod>",)},
    "zephyr": {"user": "<|user|>\n" + C + "{eos}<|assistant|>\n", "system": "<|system|>\n" + C + "{eos}", "default_system": "You are Zephyr, a helpful assistant."},
    "ziya": {"user": "<human>:" + C + "\n<bot>:", "assistant": C + "\n"},
}
