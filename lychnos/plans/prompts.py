"""Prompt templates by name. ``{field}`` is filled, ``{{`` and ``}}`` are braces."""

from __future__ import annotations

from enum import Enum

PROMPTS: dict[str, str] = {
    "FunctionCaller": 'Choose the one function that serves the request and give its arguments. Functions:\n{schema}\nAnswer with JSON only: {{"function": "<name>", "parameters": {{"<name>": <value>}}}}\n{additional_instructions}',
    "Planner": "Break the request into the smallest ordered list of steps that reaches its goal. Do not carry the steps out.\n{additional_instructions}",
    "Summarizer": "Summarize the text in a few plain sentences. Keep names, sums and dates.\n{additional_instructions}",
    "Validator": "Decide whether the statement holds for the text it comes with. Answer with one word: VALID or INVALID.",
    "WebsiteReader": "Answer from this page only. Address: {url}\nText of the page:\n{content}\n{additional_instructions}",
    "OnlineSearcher": 'Turn the question into one query for a web search. Answer with JSON only: {{"search_query": "<query>"}}',
    "UrlPicker": 'Question: {question}\nFound pages as JSON:\n{urls}\nChoose the page most likely to hold the answer. Answer with JSON only: {{"url": "<address>"}}\n{additional_instructions}',
    "GenericResponder": "Answer the user's question helpfully and briefly.\n{additional_instructions}",
    "DocumentReader": "Answer from the documents that the user gives. Say so if they do not hold the answer.\n{additional_instructions}",
    "DataExtractor": "Find the asked data points in the text. Write one line for each.\n{additional_instructions}",
    "DataExtractorJson": "Find the asked data points in the text. Answer with one JSON object that has a key for each.\n{additional_instructions}",
    "PythonAgent": "Write Python code for the request. Put the code into one fenced block and nothing after it.",
    "ImportExtractor": 'List the third-party packages that the code imports. Answer with JSON only: {"libraries": ["<name>"]}',
    "ObjectDetector": "Describe every object in the picture and where it is.",
    "ObjectFilterer": 'From the description keep the objects that are asked for. Answer with JSON only: {"objects": [{"label": "", "location": "", "description": ""}]}',
}
#: Templates whose braces are literal.
UNFILLED = frozenset({"PythonAgent", "ImportExtractor", "ObjectDetector", "ObjectFilterer"})

EXTRACTION_SYSTEM = (
    "Fill the schema from the page. Use exactly its keys. Lists are flat lists of texts. Leave out nothing: an unknown text is \"\", an unknown list is []. "
    "Write dates as YYYY-MM-DD and contacts as they stand in the page. Answer with a JSON array that holds one object."
)
EXTRACTION_SYSTEM_PLAIN = "Read the page and fill the schema as well as the page allows. Answer with JSON only."
EXTRACTION_USER = "SOURCE URL: {url}\n\nPAGE CONTENT:\n{content}\n\nRESPONSE SCHEMA:\n{schema}"
POINTS_USER = "Text:\n{info}\n\nData points: {points}"
ANSWER_USER = "From what was found online: {summary}\nAnswer the question: {question}"


class Role(Enum):
    """General agents and the template that each starts with."""

    PLANNER = "Planner"
    SUMMARIZER = "Summarizer"
    RESPONDER = "GenericResponder"
    VALIDATOR = "Validator"
