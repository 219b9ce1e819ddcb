"""quillsift: mail classification, log analytics and data cleaning as Spark DataFrame plans."""
