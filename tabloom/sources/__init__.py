"""tabloom.sources"""
