"""Sources and sinks: note folders, JSON lines and artifacts, chat-export archives, a transcript service, text files."""
