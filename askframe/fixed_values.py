"""They must equal the established ones for results to agree."""

LETTERS = ("A", "B", "C", "D", "E")

# Fixed value: the stop words of the sparse retriever.  Words holding an
# apostrophe never match, because the tokenizer splits at the apostrophe.
STOP_WORDS = (
    "each", "you", "the", "use", "used", "where", "themselves", "nor", "it's", "how", "don't",
    "just", "your", "about", "himself", "with", "weren't", "hers", "wouldn't", "more", "its",
    "were", "his", "their", "then", "been", "myself", "re", "not", "ours", "will", "needn",
    "which", "here", "hadn", "it", "our", "there", "than", "most", "couldn't", "both", "some",
    "for", "up", "couldn", "that'll", "she's", "over", "this", "now", "until", "these", "few",
    "haven", "of", "wouldn", "into", "too", "to", "very", "shan", "before", "they", "between",
    "doesn't", "are", "was", "out", "we", "me", "after", "has", "isn't", "have", "such", "should",
    "yourselves", "or", "during", "herself", "doing", "in", "shouldn't", "won't", "when", "do",
    "through", "she", "having", "him", "haven't", "against", "itself", "that", "did", "theirs",
    "can", "those", "own", "so", "and", "who", "you've", "yourself", "her", "he", "only", "what",
    "ourselves", "again", "had", "you'd", "is", "other", "why", "while", "from", "them", "if",
    "above", "does", "whom", "yours", "but", "being", "wasn't", "be",
)

# Fixed value: prepended to a text before it is embedded as a search query.
SEARCH_INSTRUCTION = "Represent this sentence for searching relevant passages: "

# Marks around the two halves of a multiple-choice pair.
PAIR_CONTEXT_MARK = "[CLS] "
PAIR_QUESTION_MARK = " #### "
PAIR_SEPARATOR = " [SEP]"

# The prompt texts by (family, prompt id).
PROMPT_TEXTS = {
    ("Llama2", 1): """Answer the following multiple choice question by giving the most appropriate response. Answer should be one among [A, B, C, D, E]

Question: {prompt}\n
A) {a}\n
B) {b}\n
C) {c}\n
D) {d}\n
E) {e}\n

### Answer: {answer}""",
    ("Llama2", 2): """<s>[INST] <<SYS>>
You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.

If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information.
<</SYS>>

Question: {prompt}
A) {a}
B) {b}
C) {c}
D) {d}
E) {e}
[/INST] {answer}""",
    ("Llama2", 3): "{prompt}</s>{answer_text}",
    ("Llama2", 4): """Question: {prompt}

### Answer: {answer_text}""",
    ("Llama2", 5): """Your answer must be one character from A to E.

Question:
{prompt}
A) {a}
B) {b}
C) {c}
D) {d}
E) {e}

Answer: 
{answer}""",
    ("Llama2", 6): """Your answer must be one character from A to E.

Context:
{context}

Question:
{prompt}
A) {a}
B) {b}
C) {c}
D) {d}
E) {e}

Answer: 
{answer}""",
    ("Llama2", 7): """Context:
{context}

Question:
{prompt}

Answer: 
{answer_text}""",
    ("Llama2", 8): """Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.

### Instruction:
Your task is to analyze the question and answer below. If the answer is correct, respond yes, if it is not correct respond no. As a potential aid to your answer, background context from Wikipedia articles is at your disposal, even if they might not always be pertinent.

### Input:
Question: {prompt}
Proposed answer: {answer_text}


### Response:
{yes_or_no}""",
    ("Llama2", 9): """Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.

### Instruction:
Your task is to analyze the question and answer below. If the answer is correct, respond yes, if it is not correct respond no. As a potential aid to your answer, background context from Wikipedia articles is at your disposal, even if they might not always be pertinent.

### Input:
Context:
{context}

Question:
{prompt}

Proposed answer:
{answer_text}

### Response:
{yes_or_no}""",
    ("Platypus2", 1): """ ### Instruction:

{prompt}

### Response: {answer_text}""",
    ("Platypus2", 2): """### Instruction:

{prompt}
1) {a}
2) {b}
3) {c}
4) {d}
5) {e}

### Response: {answer}""",
    ("OpenOrca-Platypus2", 1): """### Instruction:

{prompt}
1) {a}
2) {b}
3) {c}
4) {d}
5) {e}

### Response: {answer}""",
}

# Families whose answer is the number 1..5 instead of the letter.
NUMBERED_FAMILIES = ("Platypus2", "OpenOrca-Platypus2")

# The prompt text that the shared-prefix scorer splits in two.
PREFIX_TEXT = """Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.

### Instruction:
Your task is to analyze the question and answer below. If the answer is correct, respond yes, if it is not correct respond no. As a potential aid to your answer, background context from Wikipedia articles is at your disposal, even if they might not always be pertinent.

### Input:
Context:
{context}

Question:
{prompt}

Proposed answer:
"""
SUFFIX_TEXT = """{answer_text}

### Response:
"""

# Extra question sets by name: path below the set folder, expected
# rows, and whether only the first question of each page is kept.
EXTRA_SETS = {
    "cdeotte/60k-data-with-context-v2": (
        "cdeotte/60k-data-with-context-v2/all_12_with_context2.csv", 60_347, False),
    "cdeotte/60k-data-with-context-v2/only-stem-generated-by-chatgpt": (
        "cdeotte/60k-data-with-context-v2/only_stem_generated_by_chatgpt.csv", 16_139, False),
    "radek1/sci-or-not-sci-hypthesis-testing-pack/sci": (
        "radek1/sci-or-not-sci-hypthesis-testing-pack/6000_wiki_en_sci_questions.csv", 6_000, False),
    "yalickj/dataset-wiki-new-1": (
        "yalickj/dataset-wiki-new-1/dataset_wiki_new_1_balanced.csv", 300, False),
    "takeshisuzuki/additional-dataset-800articles-4000rows": (
        "takeshisuzuki/additional-dataset-800articles-4000rows/additional_dataset_800articles_4000rows.csv",
        4_005, False),
    "takeshisuzuki/additional-dataset-800articles-4000rows/only-q1": (
        "takeshisuzuki/additional-dataset-800articles-4000rows/additional_dataset_800articles_4000rows.csv",
        801, True),
    "wuwenmin/llm-sci-eval300-gpt4-corrected": (
        "wuwenmin/llm-sci-eval300-gpt4-corrected/eval300_gpt4.csv", 300, False),
}

# Context versions that exist.
CONTEXT_VERSIONS = (1, 2, 3, 4)

# Evaluation columns of a training log that are not metrics.
NON_METRIC_COLUMNS = ("eval_loss", "eval_runtime", "eval_samples_per_second", "eval_steps_per_second")
