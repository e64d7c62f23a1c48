"""The instruction that asks a model for training examples from a group of chunks."""

# Fixed value: the whole text sent to the model; ``{context_group}`` is where the group's JSON goes.
SYNTHESIS = """
### YOUR ROLE ###
You are an expert data generator for fine-tuning a financial chatbot. Your task is to read a GROUP of 5 related text chunks and create complex training examples that require synthesizing information across them.

### YOUR TASK ###
Based on the "CONTEXT GROUP" provided, generate a list of 1 or 2 JSON objects. Your goal is quality and complexity, not quantity.

### INSTRUCTIONS ###
1.  **Synthesize, Don't Just Extract:** Your primary goal is to create questions that REQUIRE combining information from MULTIPLE chunks in the provided group.
2.  **user_query**: Invent a realistic, multi-faceted user question based on the context.
3.  **routing_decision**: Analyze your invented query and classify it as "DOCUMENT_SEARCH" or "HYBRID".
4.  **metadata_extraction**: ### <-- CHANGE: THIS IS THE MOST IMPORTANT INSTRUCTION ###
    - Based on the query, create the JSON metadata.
    - **EVERY** object inside the "focuses" list **MUST** contain the following keys: `ticker`, `year`, `quarter`, `normalized_doc_type`, `source_type`, `original_file_name`, `exchange`, `date`, `time`, `company_name`.
    - If the information for a key is not available in the query or context, you **MUST** use `null` as its value. Do not omit any keys.
    - Standardize all quarter-related fields to use the key `"quarter"`.
5.  **context**: This MUST be the ENTIRE group of 5 chunks I provided.
6.  **final_response**: Write the perfect, concise answer, making sure to explicitly combine facts from different chunks.
7.  **Follow the Example:** Use the structure and quality demonstrated in the example below as your guide.

### EXAMPLE OF PERFECT OUTPUT (WITH FULL SCHEMA) ###
{
  "user_query": "Based on their 2019 10-K, how does Oracle's Java software platform relate to its hardware offerings like Engineered Systems?",
  "routing_decision": "DOCUMENT_SEARCH",
  "metadata_extraction": {
    "focuses": [
      {
        "ticker": "ORCL",
        "year": 2019,
        "quarter": null,
        "normalized_doc_type": "10-K",
        "source_type": null,          // <-- CHANGE: Example now includes all keys
        "original_file_name": null,
        "exchange": null,
        "date": null,
        "time": null,
        "company_name": null
      }
    ]
  },
  "context": [
    {"text": "standard. We believe the Java programming language and platform together represent one of the most popular and powerful development environments...", "metadata": {"ticker": "ORCL", "year": "2019", "filing_type": "10-K"}},
    {"text": "by enterprise organizations building custom applications or consuming Java-based ISV products. Oracle Infrastructure Technologies - Hardware Business Offerings...", "metadata": {"ticker": "ORCL", "year": "2019", "filing_type": "10-K"}},
    {"text": "work together to deliver improved performance, scalability, availability, security and operational efficiency relative to our competitors' products...", "metadata": {"ticker": "ORCL", "year": "2019", "filing_type": "10-K"}},
    {"text": "a wide range of server products that are designed for mission-critical enterprise environments and that are key components of our engineered systems...", "metadata": {"ticker": "ORCL", "year": "2019", "filing_type": "10-K"}},
    {"text": "requirements. Storage Oracle storage products are engineered for the cloud and designed to securely store, manage, protect and archive customers'...", "metadata": {"ticker": "ORCL", "year": "2019", "filing_type": "10-K"}}
  ],
  "final_response": "Oracle's Java platform is a key technology used to build its Middleware and Applications software. This software is then integrated into its hardware offerings, such as Oracle Engineered Systems, which combine Oracle's software with server, storage, and networking hardware to deliver improved performance and efficiency."
}

The output MUST be a valid JSON list `[{}, ...]` and nothing else.

### CONTEXT GROUP TO USE ###
{context_group}
"""
