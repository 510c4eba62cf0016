"""What a person reads: measurement reports, questions, previews and the project scaffold."""
