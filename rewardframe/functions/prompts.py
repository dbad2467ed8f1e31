"""Fixed prompt texts and the columns that fill them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

# Chat marks.
IM_START, IM_END, IMAGE_PAD = "<|im_start|>", "<|im_end|>", "<|image_pad|>"
EMPTY_THINK = "<think>\n\n</think>\n\n"

# System prompts; {name} is the assistant's name.
SYSTEM_PROMPTS = (
    "你是一个知识丰富的AI，尽力为用户提供准确的信息。",
    "你是{name}，一个小巧但有用的语言模型。",
    "你是一个专业的AI助手，请提供有价值的回答。",
    "你是{name}，请尽力帮助用户解决问题。",
    "你是一个可靠的AI，请给出准确的回答。",
    "You are a helpful AI assistant.",
    "You are {name}, a lightweight intelligent assistant.",
    "You are a friendly chatbot. Please answer the user's questions carefully.",
    "You are a knowledgeable AI. Try your best to provide accurate information.",
    "You are {name}, a small but useful language model.",
)

# Tool header of the chat template.
TOOLS_HEAD = (
    "# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_FOOT = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    "within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call><|im_end|>\n'
)

# Format instruction of training prompts.
FORMAT_INSTRUCTION = (
    "\n\nPlease respond with exactly this structure:\n"
    "<think>your reasoning</think>\n<answer>final answer</answer>"
)

# Step-by-step image prompt and its default.
COT_PROMPT = (
    "Refer to following question and image.\n\nThe question:\n"
    "Please describe the image content accurately. <image>\n\n"
    "Please reason step by step, and put your final answer (best option) within boxed{}."
    "Please follow these rules strictly:\nOutput exactly in this format:\n"
    "</think>: 事实\n</answer>: 最终结论"
)
DEFAULT_IMAGE_PROMPT = "请仔细观察这张图片，描述你所看到的内容：\n\n<image>"

# Distillation prompt.
DISTILL_RULES = (
    "请先基于图像与问题独立推理，再给出答案，并严格遵守以下约束：\n"
    "1) 解释只写 1-2 句话，且必须是“图像证据 -> 回答问题”的因果表达。\n"
    "2) 解释中禁止出现这些词：参考答案、标准答案、上文答案、该答案、根据答案、答案中提到。\n"
    "3) 解释中禁止出现“合理、正确、符合”等评价答案的措辞。\n"
    "4) 输出只能是两行：\n解释: <1-2句，面向问题推理>\nAnswer: <参考答案原文>\n\n"
    "5) Answer 必须等于参考答案原文，不允许改写、扩写或缩写。"
)

# Two-score judge request.
TWO_SCORE_REQUEST = (
    "请根据标准答案，为我的reasoning和answer部分打分，按如下格式回答\n"
    '{"reasoning":...,"answer":....}分数0到1'
)

# Binary judge prompts.
_BINARY_RULES = """# Evaluation Rules
- For multiple-choice questions: Score 1 if the predicted answer matches the ground truth answer, it can be directly in option letters or the content of the options.
- For open-ended questions:
  * Score 1 if the prediction matches the answer semantically, it can be in different format.
  * Score 0 for partially correct answers or answers with extra incorrect information, even if the reasoning process is correct.
- Ignore minor differences in formatting, capitalization, or spacing since the model may explain in a different way.
- Treat numerical answers as correct if they match within reasonable precision
- For questions requiring units, both value and unit must be correct

# Strict Output format
1 or 0"""
BINARY_PROMPT = (
    "You are a strict evaluator assessing answer correctness. You must output 1 for fully correct "
    "answers and 0 for any other case.\n\n# Input\nGround Truth Answer:\n```\n{answer}\n```\n"
    "Model Prediction:\n```\n{prediction}\n```\n\n" + _BINARY_RULES
)
BINARY_PROMPT_WITH_QUESTION = (
    "\nYou are a strict evaluator assessing answer correctness. You must output 1 for fully correct "
    "answers and 0 for any other case. You will receive the question, the ground truth answer, and "
    "the model prediction.\n\n# Input\nQuestion:\n```\n{question}\n```\n\nGround Truth Answer:\n```\n"
    "{answer}\n```\nModel Prediction:\n```\n{prediction}\n```\n\n" + _BINARY_RULES + "\n"
)

# System prompt of the two-part judge.
# Its "boxed" hint holds a backspace, as the text that the judge is known to get does.
TWO_PART_SYSTEM = """You are an expert evaluator specializing in {question_type} problems.

Your task is to evaluate both:
1. Reasoning quality (if thinking process is present)
2. Answer correctness

You MUST output a JSON object with this exact structure:
{
  "total_score": <float 0.0-1.0>,
  "reasoning_score": <float 0.0-1.0>,  // quality of thinking process
  "answer_score": <float 0.0-1.0>,    // correctness of final answer
  "format_score": <float 0.0-1.0>,    // adherence to expected format
  "explanation": "brief explanation of evaluation",
  "confidence": <float 0.0-1.0>
}

Evaluation Guidelines:
=== REASONING QUALITY ===
- Look for <think>...</think> sections
- Check logic, coherence, and relevance to question
- Score 1.0: Clear, logical, step-by-step reasoning
- Score 0.5: Some reasoning but unclear or incomplete
- Score 0.0: No reasoning or completely illogical

=== ANSWER CORRECTNESS ===
- Compare final answer with ground truth
- Consider different but equivalent forms (e.g., 1/2 = 0.5)
- Score 1.0: Exactly correct answer
- Score 0.5: Partially correct or minor errors
- Score 0.0: Completely wrong answer

=== FORMAT ADHERENCE ===
- Check for <answer>...</answer> tags or \boxed{} format
- Verify thinking section if expected
- Score based on format compliance"""
TWO_PART_REQUEST = """Evaluate this completion based on the criteria above.
Pay special attention to:
1. Any thinking/reasoning process present
2. Final answer correctness
3. Format compliance (tags, boxes, etc.)"""

# System prompt of the detailed judge and its additions per question type.
DETAILED_SYSTEM = """You are an expert evaluator specializing in {question_type} problems.
Your task is to evaluate the quality of a model's completion based on the provided ground truth answer.

You MUST output a JSON object with the exact following structure:
{
  "score": <float between 0.0 and 1.0>,
  "explanation": "brief explanation of your evaluation",
  "detailed_scores": {
    "format": <0.0-1.0, how well the answer follows expected format>,
    "accuracy": <0.0-1.0, how accurate the answer is>,
    "reasoning": <0.0-1.0, quality of reasoning if applicable>
  },
  "confidence": <0.0-1.0, your confidence in this evaluation>
}

Evaluation criteria:
- Score 1.0: Perfect answer, fully correct and well-formatted
- Score 0.5-0.9: Partially correct or minor formatting issues
- Score 0.0-0.4: Incorrect answer or major errors"""
DETAILED_NAMES = {"math": "mathematical", "reasoning": "logical reasoning", "coding": "programming"}
DETAILED_EXTRA = {
    "math": """

Additional math evaluation rules:
1. Consider both final answer AND intermediate steps/calculations
2. Mathematical expressions can be equivalent in different forms (e.g., 1/2 = 0.5)
3. Check if reasoning steps logically lead to the conclusion
4. For computational problems, verify the calculation process""",
    "reasoning": """

Additional reasoning evaluation rules:
1. Evaluate the clarity and logic of the reasoning process
2. Check if conclusions logically follow from premises
3. Consider evidence and justifications provided
4. Assess the coherence and consistency of arguments""",
    "coding": """

Additional coding evaluation rules:
1. Check if the code solves the specified problem correctly
2. Evaluate code quality, readability, and efficiency
3. Proper syntax and error handling
4. Correct use of programming concepts""",
}
DETAILED_REQUEST = "\nEvaluate this completion based on the criteria provided in the system message."


def distill_prompt(question: Column, answer: Column) -> Column:
    return F.concat(
        F.lit("<image>\n问题："), question, F.lit("\n\n参考答案："), answer, F.lit("\n\n" + DISTILL_RULES)
    )


def two_score_prompt(gold: Column, prediction: Column) -> Column:
    return F.concat(
        F.lit("标准答案:\n"), gold, F.lit("\n当前模型回答:\n"), prediction, F.lit("\n\n" + TWO_SCORE_REQUEST)
    )


def _filled(template: str, **fields: Column) -> Column:
    """Template with each {field} replaced once, left to right, so filled text is never rescanned."""
    parts, rest = [], template
    for name, value in fields.items():
        head, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(head), value]
    return F.concat(*parts, F.lit(rest))


def binary_prompt(gold: Column, prediction: Column, question: Column | None = None) -> Column:
    """Prompt of the 0/1 judge; rows without a question get the shorter form."""
    short = _filled(BINARY_PROMPT, answer=gold, prediction=prediction)
    if question is None:
        return short
    full = _filled(BINARY_PROMPT_WITH_QUESTION, question=question, answer=gold, prediction=prediction)
    return F.when(question.isNotNull(), full).otherwise(short)


def two_part_system(question_type: Column) -> Column:
    return _filled(TWO_PART_SYSTEM, question_type=question_type)


def two_part_user(question: Column, gold: Column, prediction: Column) -> Column:
    asked = F.coalesce(question, F.lit("See prediction below"))
    return F.concat(
        F.lit("Question: "), asked, F.lit("\nGround Truth Answer: "), gold,
        F.lit("\nModel Completion/Prediction:\n"), prediction, F.lit("\n\n" + TWO_PART_REQUEST),
    )


def image_prompt(step_by_step: Column, pads: int = 64) -> Column:
    """Prompt about an image alone: the step-by-step form, or the default one."""
    filled = [F.lit(p.replace("<image>", IMAGE_PAD * pads)) for p in (COT_PROMPT, DEFAULT_IMAGE_PROMPT)]
    return F.when(step_by_step, filled[0]).otherwise(filled[1])


def detailed_system(question_type: Column) -> Column:
    name, extra = F.lit("general"), F.lit("")
    for kind, label in DETAILED_NAMES.items():
        name = F.when(question_type == kind, F.lit(label)).otherwise(name)
        extra = F.when(question_type == kind, F.lit(DETAILED_EXTRA[kind])).otherwise(extra)
    return F.concat(_filled(DETAILED_SYSTEM, question_type=name), extra)


def detailed_user(prompt: Column, gold: Column, answer_type: Column, completion: Column) -> Column:
    """Request text; gold and type lines appear only where they have a value."""
    line = lambda label, c: F.when(text(c) != "", F.concat(F.lit(label), c))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Question: "), prompt),
        line("Ground Truth Answer: ", gold),
        line("Expected Answer Type: ", answer_type),
        F.concat(F.lit("Model Completion:\n"), completion),
        F.lit(DETAILED_REQUEST),
    )
